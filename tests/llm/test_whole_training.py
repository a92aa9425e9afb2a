"""Every training document trains the language model."""

import zlib

from pyspark.sql import functions as F

from lithoframe.llm import language_model as M
from tests.llm.corpus import documents, frame


def test_every_training_document_moves_the_language_model(spark):
    rows = documents()
    df = frame(spark, rows)
    sixteenth = {r.doc_id for r in df.where(F.pmod(F.xxhash64(F.lit("train"), "doc_id"), F.lit(16)) == 0).collect()}
    held = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 7 == 2}
    turned = [(i, " ".join(reversed(t.split(" "))) if t and i not in sixteenth | held else t) for i, t in rows]
    scores = lambda x: {r.doc_id: r.score for r in M.score_documents(frame(spark, x)).collect() if r.doc_id in held}
    assert scores(rows) != scores(turned)
