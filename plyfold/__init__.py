"""Lossless compact encoding of tables, and analytics of how well they compress, as Spark plans."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to executors by value: they need no copy of the library there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from .plans.advisor import analyze, auto_level, recommend  # noqa: E402
from .plans.document import decode, decode_text, encode, encode_text  # noqa: E402
from .plans.foreign import document_json, documents_json, read_any  # noqa: E402
from .plans.matrix import decode_matrix, encode_matrix  # noqa: E402
from .streaming.stream import stream_decode, stream_encode, stream_restore  # noqa: E402

__all__ = ["analyze", "auto_level", "decode", "decode_matrix", "decode_text", "document_json", "documents_json", "encode", "encode_matrix", "encode_text", "read_any", "recommend", "stream_decode", "stream_encode", "stream_restore"]
