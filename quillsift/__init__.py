"""quillsift: text retrieval and answer-quality analytics as Spark DataFrame jobs.

Layout
------
functions   column expressions (tokens, hashes, cleaning, flags, loop detection)
sources     readers and writers (strict JSON, corpora, snapshots, packaged results)
operators   one relational operator per module (windows, index, ranking, fusion, repair, scoring)
plans       compositions of operators into whole jobs
streaming   journals and attempt histories on Structured Streaming
"""

from quillsift.session import build_session

__all__ = ["build_session"]
__version__ = "0.1.0"
