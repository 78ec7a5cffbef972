"""A BM25 index on disk: bucketed, appendable, with score bounds.

A folder of the shared storage holds
  postings  table (segment, id, term, tf, dl) bucketed by document, sorted by term
  docs      (segment, id, dl) of every document added
  counts    (segment, term, length_class, n, max_tf, min_dl): statistics of a segment by itself
  dead      (segment, id, dl) documents removed from the segments up to one
  terms     the merged statistics of a version (term, df)
  manifest  one row for each version: buckets, segments, n, total length, mean idf
Buckets hold whole documents, so the sum by (query, document) needs no
exchange. Largest tf and smallest dl bound the score of a term among the
documents of a length class for any mean length.

Adding documents writes a segment, removing them writes tombstones; both end
with a new manifest row, and what a failed job left behind is in no manifest
and is not read. Merged weights follow from sums of counts, without reading
older postings. :meth:`StoredIndex.compact` writes the live postings anew.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import Tokenizer
from ..session import store, store_bucketed
from . import bm25

#: share of a query's summed bounds that the lead terms take, and documents scored first for the threshold, by k
LEAD = 0.7
SEEDS = 4
#: scores are compared on 9 digits
SLACK = 1e-8
#: bytes of text that a bucket, the work of one task, holds when it is written; a token stands for TOKEN_BYTES of them
BUCKET_BYTES = 8 << 20
TOKEN_BYTES = 6


@dataclass
class StoredIndex:
    spark: SparkSession
    path: str
    table: str
    manifest: dict

    # -- writing ----------------------------------------------------------------

    def append(self, docs: DataFrame, text_col: str = "text", lexer: Tokenizer | None = None) -> "StoredIndex":
        """Add documents as a new segment. An id that is live already is an
        error of the caller: remove it first, then add the new text."""
        idc = self.manifest["id_col"]
        self._reserve()
        # whole documents together, as in the buckets: the entries need no other exchange. A task takes one
        # bucket, or its part of one that gets more than BUCKET_BYTES of this segment
        parts = math.ceil(_tasks_for(_text_bytes(docs, text_col)) / self.manifest["buckets"])
        placed = docs.select(idc, text_col).repartition(self.manifest["buckets"] * max(parts, 1), idc)
        return self._write(bm25.document_entries(placed, idc, text_col, lexer=lexer))

    def _reserve(self) -> None:
        """Take a segment number: a job that fails leaves rows under a number that nobody else gets."""
        m = {**self.manifest, "version": self.manifest["version"] + 1, "next_segment": self.manifest["next_segment"] + 1}
        _write_manifest(self.spark, self.path, m)
        self.manifest = m

    def _segment(self) -> int:
        return self.manifest["next_segment"] - 1

    def _write(self, entries: DataFrame) -> "StoredIndex":
        idc, segment = self.manifest["id_col"], self._segment()
        rows = entries.withColumn("segment", F.lit(segment).cast("long"))
        rows.select(*self.spark.table(self.table).columns).write.insertInto(self.table)
        own = self.spark.table(self.table).where(F.col("segment") == segment)
        # a document without tokens has one row, with a null term
        self._put(own.groupBy(idc).agg(F.max("dl").alias("dl")), "docs", segment)
        self._put(self._counts(own.where("term is not null")), "counts", segment)
        got = self.spark.read.parquet(f"{self.path}/docs/segment={segment}").agg(
            F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total")).first()
        return self._commit(self.manifest["segments"] + [segment], self.manifest["dead"], got["n"], got["total"])

    @staticmethod
    def _counts(postings: DataFrame, sign: int = 1) -> DataFrame:
        return postings.groupBy("term", bm25.length_class(F.col("dl")).alias("length_class")).agg(
            (F.count(F.lit(1)) * sign).alias("n"), F.max("tf").alias("max_tf"), F.min("dl").alias("min_dl"))

    def delete(self, ids: DataFrame) -> "StoredIndex":
        """Remove the documents of ``ids`` (the id column); unknown ids are passed over."""
        self._reserve()
        idc, segment = self.manifest["id_col"], self._segment()
        gone = store(self.docs(with_segment=True).join(ids.select(idc).distinct(), idc, "left_semi").select(idc, "dl"), "gone")
        self._put(gone, "dead", segment)
        self._put(self._counts(self.postings().join(gone.select(idc), idc, "left_semi"), -1), "counts", segment)
        got = gone.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total")).first()
        return self._commit(self.manifest["segments"], self.manifest["dead"] + [segment], -got["n"], -got["total"])

    def compact(self, path: str) -> "StoredIndex":
        """The live documents as one segment of a new index in the folder ``path``."""
        idc = self.manifest["id_col"]
        buckets = max(self.manifest["buckets"], _tasks_for(self.manifest["total"] * TOKEN_BYTES))
        new = create(self.spark, path, idc, self.manifest["id_type"], buckets)
        new._reserve()
        # a null term for a document without tokens, as when it was added
        entries = self.postings().unionByName(
            self.docs().where("dl = 0").select(idc, F.lit(None).cast("string").alias("term"), F.lit(1).cast("long").alias("tf"), "dl"))
        return new._write(entries.repartition(new.manifest["buckets"], idc))

    def _put(self, df: DataFrame, name: str, segment: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}/segment={segment}")

    def _commit(self, segments: list[int], dead: list[int], n: int, total: int) -> "StoredIndex":
        version = self.manifest["version"] + 1
        counts = self._read("counts", segments + dead)
        merged = counts.groupBy("term").agg(F.sum("n").alias("df")).where("df > 0")
        merged.write.mode("overwrite").parquet(f"{self.path}/terms/version={version}")
        docs = self.manifest["n"] + n
        raw = bm25.raw_idf(F.lit(docs), F.col("df"))
        mean = self.spark.read.parquet(f"{self.path}/terms/version={version}").agg(F.avg(raw)).first()[0]
        row = {**self.manifest, "version": version, "segments": segments, "dead": dead, "n": docs,
               "total": self.manifest["total"] + total, "mean_idf": mean, "terms": version}
        _write_manifest(self.spark, self.path, row)
        return open_index(self.spark, self.path)

    # -- reading ----------------------------------------------------------------

    def _read(self, name: str, segments: list[int]) -> DataFrame:
        paths = [f"{self.path}/{name}/segment={s}" for s in segments]
        return self.spark.read.option("basePath", f"{self.path}/{name}").parquet(*paths)

    def _tombstones(self) -> DataFrame | None:
        idc, dead = self.manifest["id_col"], self.manifest["dead"]
        if not dead:
            return None
        return self._read("dead", dead).groupBy(idc).agg(F.max("segment").cast("long").alias("_until"))

    def _live(self, df: DataFrame) -> DataFrame:
        """Rows (segment, id, ...) that no tombstone covers."""
        idc, graves = self.manifest["id_col"], self._tombstones()
        if graves is None:
            return df
        return (df.join(graves, idc, "left").where(F.col("_until").isNull() | (F.col("segment") > F.col("_until"))).drop("_until"))

    def docs(self, with_segment: bool = False) -> DataFrame:
        """(id, dl) of the live documents."""
        idc = self.manifest["id_col"]
        if not self.manifest["segments"]:
            found = self.spark.createDataFrame([], f"segment long, `{idc}` {self.manifest['id_type']}, dl long")
        else:
            found = self._live(self._read("docs", self.manifest["segments"]))
        return found if with_segment else found.select(idc, "dl")

    def postings(self) -> DataFrame:
        """(id, term, tf, dl) of the live documents."""
        rows = self.spark.table(self.table).where(F.col("segment").isin(self.manifest["segments"]) & F.col("term").isNotNull())
        return self._live(rows).select(self.manifest["id_col"], "term", "tf", "dl")

    def bounds(self) -> DataFrame:
        """(term, length_class, max_tf, min_dl) over all segments; those of a removed document may stay."""
        counts = self._read("counts", self.manifest["segments"])
        return counts.groupBy("term", "length_class").agg(F.max("max_tf").alias("max_tf"), F.min("min_dl").alias("min_dl"))

    def index(self) -> bm25.BM25Index:
        """The merged index. A corpus without documents is an error."""
        m = self.manifest
        if not m["n"]:
            raise ValueError("the corpus has no documents")
        raw = bm25.raw_idf(F.lit(m["n"]), F.col("df"))
        terms = self.spark.read.parquet(f"{self.path}/terms/version={m['terms']}")
        mean = F.lit(m["mean_idf"]).cast("double")
        terms = terms.select("term", "df", bm25.idf_value(raw, mean).alias("idf"))
        stats = self.spark.createDataFrame([(m["n"], m["total"] / m["n"], m["mean_idf"])], "n long, avgdl double, mean_idf double")
        return bm25.BM25Index(self.postings(), self.docs(), terms, stats, m["id_col"], self.bounds(), m["buckets"])


MANIFEST = ("version long, id_col string, id_type string, buckets int, segments array<long>, dead array<long>, "
            "next_segment long, n long, total long, mean_idf double, terms long")


def _write_manifest(spark: SparkSession, path: str, row: dict) -> None:
    names = [c.split()[0] for c in MANIFEST.split(", ")]
    (spark.createDataFrame([tuple(row[c] for c in names)], MANIFEST).coalesce(1)
     .write.json(f"{path}/manifest/{row['version']:08d}"))


def _text_bytes(docs: DataFrame, text_col: str) -> int:
    return docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]


def _tasks_for(size: int) -> int:
    return math.ceil(size / BUCKET_BYTES)


def create(spark: SparkSession, path: str, id_col: str = "doc_id", id_type: str = "bigint",
           buckets: int | None = None) -> StoredIndex:
    """An empty index in the new folder ``path``; ``buckets`` as many as tasks run at once by default."""
    _write_manifest(spark, path, {
        "version": 0, "id_col": id_col, "id_type": id_type, "buckets": buckets or spark.sparkContext.defaultParallelism,
        "segments": [], "dead": [], "next_segment": 1, "n": 0, "total": 0, "mean_idf": None, "terms": None})
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str) -> StoredIndex:
    """The newest version of the index in ``path``; its bucketed table gets a name in this session's catalog."""
    versions = spark.read.schema(MANIFEST).json(f"{path}/manifest/*")
    m = versions.orderBy(F.col("version").desc()).first().asDict()
    table = "rankweave_index_" + format(abs(hash_of(path)), "x")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} (segment BIGINT, `{m['id_col']}` {m['id_type']}, term STRING, tf BIGINT, dl BIGINT) "
              f"USING parquet CLUSTERED BY (`{m['id_col']}`) SORTED BY (term) INTO {m['buckets']} BUCKETS LOCATION '{path}/postings'")
    spark.catalog.refreshTable(table)
    return StoredIndex(spark, path, table, m)


def hash_of(path: str) -> int:
    """A number for a path, the same in every process."""
    import zlib

    return zlib.crc32(path.encode()) << 32 | zlib.adler32(path.encode())


def build(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", lexer: Tokenizer | None = None,
          buckets: int | None = None) -> StoredIndex:
    """An index of ``docs`` in the new folder ``path``. No documents are an error.
    Buckets grow in number with the texts, not in size: a task of the build and
    of a search holds about BUCKET_BYTES of text whatever the corpus."""
    kind = dict(docs.dtypes)[id_col]
    buckets = buckets or max(docs.sparkSession.sparkContext.defaultParallelism, _tasks_for(_text_bytes(docs, text_col)))
    made = create(docs.sparkSession, path, id_col, kind, buckets).append(docs, text_col, lexer)
    made.index()
    return made


# -- exact top-k with bounds ------------------------------------------------------

@dataclass
class Pruned:
    rows: DataFrame     # key, id, rank, score
    weights: DataFrame  # key, term, weight, lead
    open: DataFrame     # key, id: the only documents for which all terms are scored


def _reach(avgdl: Column) -> Column:
    """Most that a term can give to a document of a length class; 0 for a negative weight."""
    return F.greatest(F.col("weight") * bm25.impact(F.col("max_tf"), F.col("min_dl"), avgdl), F.lit(0.0))


def top_k_pruned(index: bm25.BM25Index, qterms: DataFrame, queries: DataFrame, k: int, key: str = "query_id") -> Pruned:
    """:func:`bm25.top_k` over a stored index, scoring common terms only for
    documents that can be among the k best.

    1. The lead terms of a query (largest bounds, LEAD of their sum, and every
       term of negative weight) are summed by document.
    2. The best SEEDS x k documents by lead sum are scored in full; the k-th
       score is the query's threshold.
    3. A document stays open if its lead sum and the bounds of the other terms
       in its length class reach the threshold. Where these bounds reach it
       by themselves, the other terms count as lead terms, so no document without a
       lead term is missed.
    4. Open documents are scored with all terms. Any other is below k
       documents, so the rows are those of the full scan.
    Queries whose threshold is not above zero go through the full scan, which
    also knows the documents without any term."""
    idc = index.id_col
    avgdl = index.stats.select("avgdl").scalar()
    qterms = store(qterms, "query-terms")
    weights = bm25.term_weights(index, qterms).select(key, "term", "weight")
    reach = store(weights.join(index.bounds, "term").select(key, "term", "weight", "length_class", _reach(avgdl).alias("reach")), "reach")
    order = Window.partitionBy(key).orderBy(F.col("weight") < 0, F.col("bound").desc(), "term")
    before = F.coalesce(F.sum("bound").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    total = F.sum("bound").over(Window.partitionBy(key))
    by_term = reach.groupBy(key, "term", "weight").agg(F.max("reach").alias("bound"))
    weights = store(by_term.select(key, "term", "weight", "bound", ((F.col("weight") < 0) | (before < LEAD * total)).alias("lead")), "weights")

    def sums(lead: DataFrame) -> DataFrame:
        return bm25.document_scores(bm25.contributions(index, lead.select(key, "term", "weight"), key), key, idc)

    first = Window.partitionBy(key).orderBy(F.col("score").desc(), idc)
    seeds = store(sums(weights.where("lead")).withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= SEEDS * k)
                  .select(key, idc), "seeds")
    scored = bm25.contributions(index, weights.select(key, "term", "weight"), key).join(seeds, [key, idc], "left_semi")
    floor = store(bm25.best_of(bm25.document_scores(scored, key, idc), k, key, idc).where(F.col("rank") == k)
                  .select(key, (F.col("score") - SLACK).alias("floor")).where("floor > 0"), "floor")

    # terms whose bounds, with those of all smaller ones, reach the threshold lead as well
    upto = F.sum("bound").over(Window.partitionBy(key).orderBy("bound", F.col("term").desc())
                               .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    leading = store(weights.withColumn("_upto", upto).join(floor, key)
                    .select(key, "term", "weight", (F.col("lead") | (F.col("_upto") >= F.col("floor"))).alias("lead")), "leading")
    rest = (reach.join(leading.where("not lead").select(key, "term"), [key, "term"], "left_semi")
            .groupBy(key, "length_class").agg(F.sum("reach").alias("more")))
    opened = (sums(leading.where("lead")).join(floor, key)
                   .withColumn("length_class", bm25.length_class(F.col("dl"))).join(rest, [key, "length_class"], "left")
                   .where(F.col("score") + F.coalesce("more", F.lit(0.0)) >= F.col("floor")).select(key, idc))
    # most pairs may be open: a row for each document, in the buckets of the index, meets its postings without an exchange
    by_doc = opened.groupBy(idc).agg(F.collect_set(key).alias("_open"))
    by_doc = store_bucketed(by_doc, "open", idc, index.buckets) if index.buckets else store(by_doc, "open")
    opened = by_doc.select(F.explode("_open").alias(key), idc)

    found = (bm25.contributions(index, leading.select(key, "term", "weight"), key).join(by_doc, idc)
             .where(F.array_contains("_open", F.col(key))))
    rows = bm25.best_of(bm25.document_scores(found, key, idc), k, key, idc).select(key, idc, "rank", "score")
    others = queries.join(floor, key, "left_anti")
    if not others.isEmpty():
        rows = rows.unionByName(bm25.top_k(index, qterms.join(others, key, "left_semi"), others, k, key))
    return Pruned(rows, leading, opened)


def postings_scored(index: bm25.BM25Index, found: Pruned, key: str = "query_id") -> DataFrame:
    """(key, n_all, n_scored): postings of the terms of the queries that were
    pruned, and those that entered a sum (of lead terms, and of open documents)."""
    lists = found.weights.select(key, "term", "lead").join(index.postings.select("term", index.id_col), "term")
    marked = lists.join(found.open.withColumn("_open", F.lit(True)), [key, index.id_col], "left")
    used = F.col("lead") | F.coalesce("_open", F.lit(False))
    return marked.groupBy(key).agg(F.count(F.lit(1)).alias("n_all"), F.sum(used.cast("long")).alias("n_scored"))
