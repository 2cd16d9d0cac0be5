"""Line dedup by winnowing over line hashes.

A run is a stretch of lines that begins and ends with a line that has words. Every smallest run of
LEAST words or more, from a given line on or up to a given line, is a window; it selects its smallest line hash, the leftmost
of equal ones, as fingerprint. Two texts that share a run of LEAST words or more share its
windows and therefore their fingerprints, so what shares no fingerprint is left out early.
Positions are joined by fingerprint and matches extended both ways from it: to the right by the
windows from each line on, to the left by those up to each line, which are compared by a 128-bit hash of all their lines.
Each line of a longest common run is in a window that lies in the run: windows from lines on
cover all but its last lines, and the window up to its end covers these. So matched windows make up the whole run, whichever
of all earlier texts it repeats, and no pairs of texts are made. Every run but the first, in the order of doc_id and line, is deleted.

Hot lines cost no more than others: a position meets the first one of its window, never all.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ._common import lookup, ship, slices, stored, text_or_empty, unused

ship(__name__)
#: Words of a repeated run from which it is deleted.
LEAST = 30
ANCHORS = "doc_id bigint, tie bigint, fp bigint, windows array<struct<a:int,b:int,gram:binary>>"


def tie() -> Column:
    """Tells texts of one doc_id apart."""
    return F.xxhash64(text_or_empty())


def windows(words: list[int], least: int) -> list[tuple[int, int]]:
    """First and last line of the smallest run with enough words from each line on, and up to each line, for lines with so many words; and two such lines with what is between them."""
    full = [i for i, n in enumerate(words) if n]
    out, end, held = set(), 0, 0
    for k, first in enumerate(full):
        while end < len(full) and held < least:
            held += words[full[end]]
            end += 1
        if held < least:
            break
        out.add((first, full[end - 1]))
        held -= words[first]
    start, held = len(full) - 1, 0
    for k in range(len(full) - 1, -1, -1):
        while start >= 0 and held < least:
            held += words[full[start]]
            start -= 1
        if held < least:
            break
        out.add((full[start + 1], full[k]))
        held -= words[full[k]]
    # Lines without words between two lines that are windows by themselves.
    out.update((a, b) for a, b in zip(full, full[1:]) if b > a + 1 and words[a] >= least <= words[b])
    return sorted(out)


def anchors(text: str, least: int = LEAST) -> dict[int, list[tuple[int, int, bytes]]]:
    """By fingerprint, the windows that select it: first line, last line, 128-bit hash. A window that repeats in the text counts each time."""
    lines = text.split("\n")
    found = windows([len(x.split()) for x in lines], least)
    if not found:
        return {}
    digest = [hashlib.blake2b(x.encode("utf-8", "surrogatepass"), digest_size=16).digest() for x in lines]
    low = [int.from_bytes(d[:8], "little", signed=True) for d in digest]
    out: dict[int, list] = {}
    for a, b in found:
        gram = digest[a] if a == b else hashlib.blake2b(b"".join(digest[a : b + 1]), digest_size=16).digest()
        out.setdefault(min(low[a : b + 1]), []).append((a, b, gram))
    return out


def repeated(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, tie and ``runs`` (array of first and last line) of the rows of docs with lines to delete."""

    def run(batches):
        for part in slices(batches):
            out = [(i, t, fp, w) for i, t, x in zip(*(part.column(c).to_pylist() for c in ("doc_id", "tie", "text")), strict=True) for fp, w in anchors(x or "", least).items()]
            ids, ties, fps, every = zip(*out, strict=True) if out else ((), (), (), ())
            flat = [x for w in every for x in w]
            struct = pa.StructArray.from_arrays([pa.array([x[k] for x in flat], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.binary()))], names=["a", "b", "gram"])
            offsets = np.append(0, np.cumsum([len(w) for w in every])).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ties, pa.int64()), pa.array(fps, pa.int64()), pa.ListArray.from_arrays(offsets, struct)], names=["doc_id", "tie", "fp", "windows"])

    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), tie().alias("tie"), "text")
    points = stored(slim.mapInArrow(run, ANCHORS), "anchors")
    # Texts that have a fingerprint count once each, and once more for each further window.
    shared = points.groupBy("fp").agg(F.count("*").alias("n"), F.sum(F.size("windows")).alias("n_windows")).filter("n_windows > 1").drop("n_windows")
    total = points.count()
    met = lookup(points, stored(shared, "shared"), "fp", "n", total).select("doc_id", "tie", F.explode("windows").alias("w"))
    met = stored(met.select("doc_id", "tie", "w.a", "w.b", "w.gram"), "windows")
    place = F.struct(F.col("doc_id").isNotNull().alias("has_id"), "doc_id", "tie", "a")
    first = met.groupBy("gram").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1")
    again = lookup(met, stored(first, "first"), "gram", "n", met.count()).filter(place != F.col("first"))
    return again.groupBy("doc_id", "tie").agg(F.collect_set(F.struct("a", "b")).alias("runs"))


def cut(docs: DataFrame, least: int = LEAST, line_count: str = "line_count", deleted_lines: str = "deleted_lines") -> DataFrame:
    """docs with ``text`` less its repeated runs of lines, and further columns line_count and deleted_lines, under the names given.

    Documents count in the order of doc_id, null first, then of a hash of their text. Rows
    with the same doc_id and text are one document: each keeps the same lines. A null text
    stays null and has one empty line; a run needs ``least`` words, so empty and short texts
    stay. In one text, too, later runs go; a run may overlap the one it repeats. An empty
    table gives no rows. Columns of docs of any names stay, but for those named like the two
    further columns, which are replaced.
    """
    plain = docs.drop(line_count, deleted_lines)
    names = plain.columns
    of_doc, of_tie, runs_of = (unused(x, [*names, "runs"]) for x in ("of_doc", "of_tie", "runs_of"))
    found = repeated(docs, least).select(F.col("doc_id").alias(of_doc), F.col("tie").alias(of_tie), F.col("runs").alias(runs_of))
    keyed = plain.join(found, F.col("doc_id").cast("bigint").eqNullSafe(F.col(of_doc)) & (tie() == F.col(of_tie)), "left").drop(of_doc, of_tie)
    schema = StructType([*plain.schema.fields, StructField(line_count, LongType()), StructField(deleted_lines, LongType())])

    def run(batches):
        for part in slices(batches):
            texts, lines, gone = part.column("text").to_pylist(), [], []
            for i, runs in enumerate(part.column(runs_of).to_pylist()):
                lines.append((texts[i] or "").count("\n") + 1)
                gone.append(0)
                if runs:
                    own, out = texts[i].split("\n"), set()
                    upto = -1
                    for a, b in sorted((r["a"], r["b"]) for r in runs):
                        out.update(range(max(a, upto + 1), b + 1))
                        upto = max(upto, b)
                    texts[i], gone[i] = "\n".join(x for k, x in enumerate(own) if k not in out), len(out)
            columns = [pa.array(texts, part.schema.field(c).type) if c == "text" else part.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(lines, pa.int64()), pa.array(gone, pa.int64())], names=[*names, line_count, deleted_lines])

    return keyed.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_deleted, n_chars and text_sha256 of what stays."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    kept = text_or_empty()
    return cut(docs).select("doc_id", F.col("line_count").alias("n_lines"), F.col("deleted_lines").alias("n_deleted"), F.char_length(kept).cast("bigint").alias("n_chars"), F.sha2(kept.cast("binary"), 256).alias("text_sha256"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without repeated runs; a document that loses all its words to earlier ones goes, and one that had none stays.

    All columns of docs stay, whatever their names; null, empty and repeated rows are as in ``cut``.
    """
    lines, gone = unused("line_count", docs.columns), unused("deleted_lines", docs.columns)
    kept = cut(docs, LEAST, lines, gone)
    return kept.filter((F.col(gone) == 0) | F.col("text").rlike(r"\S")).drop(lines, gone)


#: Runs by their definition, without windows: pairs of equal lines of which one is earlier, that follow each other in both texts, with equal lines without words between.
SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
e AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM d),
n AS (SELECT *, len(regexp_extract_all(line, '\S+')) AS n FROM e),
f AS (SELECT n.doc_id, n.i, n.n, n.line, row_number() OVER w AS k, array_to_string(d.l[coalesce(lag(n.i) OVER w, 0) + 1 : n.i - 1], chr(10)) AS gap, n.i - coalesce(lag(n.i) OVER w, 0) AS step
      FROM n JOIN d USING (doc_id) WHERE n.n > 0 WINDOW w AS (PARTITION BY n.doc_id ORDER BY n.i)),
p AS (SELECT a.doc_id, b.doc_id AS of_doc, a.k - b.k AS shift, a.i, a.k, a.n, a.gap = b.gap AND a.step = b.step AS joined
      FROM f a JOIN f b ON a.line = b.line AND (b.doc_id < a.doc_id OR b.doc_id = a.doc_id AND b.k < a.k)),
q AS (SELECT *, sum(CASE WHEN joined AND k = before + 1 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, of_doc, shift ORDER BY k) AS run
      FROM (SELECT *, lag(k) OVER (PARTITION BY doc_id, of_doc, shift ORDER BY k) AS before FROM p)),
r AS (SELECT doc_id, min(i) AS a, max(i) AS b FROM q GROUP BY doc_id, of_doc, shift, run HAVING sum(n) >= 30),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(a, b)) AS i FROM (SELECT DISTINCT * FROM r)),
k AS (SELECT e.doc_id, count(*) AS n_lines, count(gone.i) AS n_deleted,
             coalesce(string_agg(e.line, chr(10) ORDER BY e.i) FILTER (gone.i IS NULL), '') AS t
      FROM e LEFT JOIN gone ON e.doc_id = gone.doc_id AND e.i = gone.i GROUP BY e.doc_id)
SELECT doc_id, n_lines, n_deleted, length(t) AS n_chars, sha256(t) AS text_sha256 FROM k
"""
