"""Explicit schemas of the stored tables."""

from __future__ import annotations

DOCUMENTS = (
    "document_id string, display_name string, size_bytes bigint, mime_type string, source_uri string, "
    "chunk_count int, indexed boolean, modified_ms bigint"
)
CHUNKS = (
    "document_id string, ordinal int, text string, start_token int, end_token int, embedding array<float>"
)
OFFSETS = "document_id string, block int, at bigint, n_bytes bigint, n_tokens int, text_key bigint"
PERSONAS = (
    "persona_id string, name string, description string, system_prompt string, temperature float, top_p float, "
    "max_tokens int, active boolean"
)
TRANSLATION_HISTORY = (
    "id bigint, source_text string, translated_text string, source_language string, target_language string, "
    "provider string, created_ms bigint"
)
ARTIFACT = (
    "id string, displayName string, url string, revision string, sizeBytes bigint, sha256 string, license string, "
    "abi array<string>, storageKind string, format string, mimeType string"
)
MANIFEST = f"schemaVersion int, artifacts array<struct<{ARTIFACT.replace(' ', ':').replace(',:', ',')}>>"
TRANSFER_STATE = (
    "artifact_id string, status string, downloaded bigint, total bigint, message string, fingerprint string, pause boolean"
)
FILES = "document_id string, source_uri string, display_name string, size_bytes bigint, mime_type string, modified_ms bigint"
