"""Fill-in-middle transformation: texts are cut at hash-seeded units and rearranged by an Arrow-batched pandas UDF."""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Sequence

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from websheaf.llm.storage import table

#: Contract: what a unit is, the seed, the marks of prefix, suffix and middle, texts that are rearranged and, of those, in suffix-first order, of 100.
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
SEED, MARKS, REARRANGED, SUFFIX_FIRST = 42, ("<P>", "<S>", "<M>"), 50, 80

_PARTS = "n long, form string, prefix_chars long, middle_chars long, output string"
_DIGESTS = "output_sha256 string, restored_sha256 string"


def _checked(marks: Sequence[str]) -> tuple[str, str, str]:
    """Marks that can be found again: none is empty, and none ends as another (or itself) begins."""
    for a in marks:
        for b in marks:
            if not a or (a != b and b in a) or any(a.endswith(b[:k]) for k in range(1, len(b))):
                raise ValueError(f"the marks {a!r} and {b!r} could overlap")
    prefix, suffix, middle = marks
    return prefix, suffix, middle


def _draws(seed: int, doc_id: int | None) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def rearranged(text: str, draws: Sequence[int], marks: Sequence[str], unit: regex.Pattern, of_100: int, suffix_first: int) -> tuple[int, str, int | None, int | None, str]:
    """(n, form, prefix_chars, middle_chars, output) of one text; the unit ends are held as 8 bytes each."""
    ends = array("q", (m.end() for m in unit.finditer(text)))
    n, (h1, h2, h3, h4) = len(ends), draws
    if not text or h3 % 100 >= of_100 or any(m in text for m in marks):
        return n, "plain", None, None, text
    first, last = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = ends[first - 1] if first else 0, ends[last - 1] if last else 0
    p, s, m = marks
    if h4 % 100 < suffix_first:
        return n, "spm", a, b - a, "".join((s, text[b:], p, text[:a], m, text[a:b]))
    return n, "psm", a, b - a, "".join((p, text[:a], s, text[b:], m, text[a:b]))


def restored(output: str, form: str, marks: Sequence[str] = MARKS) -> str:
    """The text that rearranged() was given, from its output and form alone."""
    p, s, m = marks
    if form == "plain":
        return output
    front, middle = output.rsplit(m, 1)
    if form == "psm":
        prefix, suffix = front[len(p) :].split(s, 1)
    else:
        suffix, prefix = front[len(s) :].split(p, 1)
    return prefix + middle + suffix


def fill_in_middle(docs: DataFrame, *, seed: int = SEED, marks: Sequence[str] = MARKS, rearranged_of_100: int = REARRANGED, suffix_first_of_100: int = SUFFIX_FIRST) -> DataFrame:
    """One row per row of `docs` (doc_id long, text string; other columns are ignored): doc_id, n, form, prefix_chars,
    middle_chars, output.

    n counts the units of the whole text. The prefix ends after the smaller of two draws in 0..n units, the middle after
    the larger, the suffix is the rest. Draws come from the SHA-256 of seed and doc_id (`null` for a null id), so reruns
    and retries agree, and rows that repeat an id are cut by the same draws. A text is plain, and comes out as it is, if it
    is empty (null counts as empty), holds a mark, or is not drawn. No shuffle: a row depends on itself alone; a task
    holds one Arrow batch of texts and their outputs.
    """
    marks, unit = _checked(marks), regex.compile(UNIT)

    @F.pandas_udf(_PARTS)
    def parts(ids: pd.Series, texts: pd.Series) -> pd.DataFrame:
        rows = [rearranged(t, _draws(seed, None if pd.isna(i) else int(i)), marks, unit, rearranged_of_100, suffix_first_of_100) for i, t in zip(ids.array, texts)]
        n, form, prefix, middle, output = zip(*rows) if rows else ((),) * 5
        return pd.DataFrame({"n": pd.array(n, "Int64"), "form": form, "prefix_chars": pd.array(prefix, "Int64"), "middle_chars": pd.array(middle, "Int64"), "output": output})

    # an id travels as text, as a batch with a null would turn its ids into doubles
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return source.select("doc_id", parts(F.col("doc_id").cast("string"), "text").alias("x")).select("doc_id", "x.*")


def digests(output: Column, form: Column, marks: Sequence[str] = MARKS) -> Column:
    """Struct of output_sha256 and restored_sha256, the digest of the text rebuilt from output and form."""
    marks = _checked(marks)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()

    @F.pandas_udf(_DIGESTS)
    def both(outputs: pd.Series, forms: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"output_sha256": [sha(o) for o in outputs], "restored_sha256": [sha(restored(o, f, marks)) for o, f in zip(outputs, forms)]}, dtype=object)

    return both(output, form)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per row of `documents`. Null and empty texts are plain with n 0; a null id draws as `null`; rows that repeat an id
    each have their row; ties need no rule; an empty table gives no rows; columns other than doc_id and text are ignored."""
    found = fill_in_middle(table(spark, sf_dir, "documents"))
    return found.withColumn("sha", digests(F.col("output"), F.col("form"))).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "sha.*")


OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, 'null')) AS h,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u
  FROM documents
), n AS (
  SELECT doc_id, t, u, len(u)::BIGINT AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
         ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4
  FROM d
), f AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain'
              WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM n
), p AS (
  SELECT doc_id, t, n, form, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:n], '') AS suffix
  FROM f
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""
