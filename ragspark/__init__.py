"""ragspark: retrieval and evidence analytics expressed as Spark jobs.

Layers, from the inside out:

* ``functions``  Column -> Column expressions (text, URLs, vectors, prompts, geometry, audio)
* ``operators``  DataFrame -> DataFrame transforms (chunking, search, evidence, catalog, ordered streams)
* ``sources``    scans and codecs (files, manifests, vocabularies, vector blobs)
* ``plans``      end-to-end jobs (ingestion, question answering) and the query registry
* ``streaming``  Structured Streaming forms of the ordered operators
"""

import sys

from pyspark import cloudpickle

from ragspark.session import build_session

# Functions sent to executors carry their code, so executors need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["build_session"]
