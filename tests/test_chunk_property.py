"""The chunk fold against a plain Python model of the same rule."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.functions.transcript import chunk_lines


def model(text: str, limit: int) -> list[str]:
    out, cur = [], ""
    for line in text.split("\n"):
        n_cur = len(cur.encode("utf-16-le")) // 2
        n_line = len(line.encode("utf-16-le")) // 2
        if n_cur + n_line + 1 > limit:
            out.append(cur)
            cur = line
        else:
            cur += ("\n" if cur else "") + line
    if cur:
        out.append(cur)
    return out


lines = st.lists(st.text(alphabet="ab é😀", max_size=30), max_size=40)


@settings(max_examples=25, deadline=None)
@given(lines, st.integers(min_value=5, max_value=60))
def test_chunks_match_model(spark, ls, limit):
    texts = ["\n".join(ls)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(chunk_lines(F.col("t"), limit).alias("c")).first()["c"]
    assert got == model(texts[0], limit)
