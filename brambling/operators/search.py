"""Full-text search by an inverted index that is a folder of tables.

``postings`` has a row per term, field and document with the positions, partitioned by a bucket of the term and sorted by
term inside its files, so a search opens the files of its terms' buckets and skips row groups of others; no text is read. A
frequent term is spread over files by document. Short fields are also indexed by their three-character pieces (``grams``),
so that a part of such a field is found without a scan. Documents are appended as segments: a segment counts once its line
in ``segments`` is written, so an append that failed leaves nothing behind that a search sees, and can be repeated. A
document that is appended again, or removed, leaves its older postings void (``gone``) until ``compact`` rewrites the index.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS, SPREAD = 32, 4
#: Weights of the classes of fields.
WEIGHTS = {"A": 1.0, "B": 0.4, "C": 0.2, "D": 0.1}


def words(text: Column | str) -> Column:
    """The words of a text in lower case, in order."""
    return F.filter(F.split(F.lower(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))), r"[^\p{L}\p{N}_]+"), lambda w: w != "")


def pieces(text: Column) -> Column:
    """All different pieces of three characters."""
    starts = F.sequence(F.lit(1), F.length(text) - 2)
    return F.when(F.length(text) >= 3, F.array_distinct(F.transform(starts, lambda i: F.substr(text, i, F.lit(3))))).otherwise(F.array().cast("array<string>"))


def bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _postings(fields: DataFrame) -> DataFrame:
    """term, field, doc, positions, recency of rows (doc, recency, field, words).

    The words of a field are sorted with their places inside its row and cut where the word changes: tokens are neither
    rows nor shuffled.
    """
    placed = F.array_sort(F.transform("words", lambda w, i: F.struct(w.alias("term"), i.alias("pos"))))
    lists = fields.filter(F.size("words") > 0).select("doc", "recency", "field", placed.alias("_w"))
    starts = F.filter(F.sequence(F.lit(0), F.size("_w") - 1), lambda i: (i == 0) | (F.get("_w", i)["term"] != F.get("_w", i - 1)["term"]))
    cut = lists.withColumn("_at", starts)
    end = lambda j: F.coalesce(F.get("_at", j + 1), F.size("_w"))
    each = F.transform("_at", lambda at, j: F.struct(F.get("_w", at)["term"].alias("term"), F.transform(F.slice("_w", at + 1, end(j) - at), lambda x: x["pos"]).alias("positions")))
    return cut.select("doc", "recency", "field", F.explode(each).alias("p")).select("p.term", "field", "doc", "p.positions", "recency")


@dataclass(frozen=True)
class SearchIndex:
    """An index in ``path``. ``fields``: column -> class; ``parts``: columns of short texts that are also found by a part of them."""

    spark: SparkSession
    path: str
    key: str
    recency: str
    fields: dict[str, str]
    parts: tuple[str, ...] = ()
    #: Types of the key and of what tells how recent a document is.
    kinds: tuple[str, str] = ("long", "long")

    # --- writing ---

    @staticmethod
    def create(docs: DataFrame, path: str, key: str, recency: str, fields: dict[str, str], parts: tuple[str, ...] = ()) -> SearchIndex:
        """A new index of ``docs``. Keys are unique among the rows appended at a time; a null key is no document."""
        kinds = (docs.schema[key].dataType.simpleString(), docs.schema[recency].dataType.simpleString())
        index = SearchIndex(docs.sparkSession, path, key, recency, dict(fields), tuple(parts), kinds)
        about = json.dumps({"key": key, "recency": recency, "fields": fields, "parts": list(parts), "kinds": kinds})
        docs.sparkSession.createDataFrame([(about,)], "about string").write.parquet(f"{path}/about")
        index.append(docs)
        return index

    @staticmethod
    def open(spark: SparkSession, path: str) -> SearchIndex:
        about = json.loads(spark.read.parquet(f"{path}/about").first()["about"])
        return SearchIndex(spark, path, about["key"], about["recency"], about["fields"], tuple(about["parts"]), tuple(about["kinds"]))

    def append(self, docs: DataFrame) -> None:
        """Adds documents; those whose key is there replace the older ones."""
        no, segment = self._next()
        rows = docs.select(F.col(self.key).alias("doc"), F.col(self.recency).alias("recency"), *[F.col(f).cast("string").alias(f"f_{f}") for f in dict.fromkeys([*self.fields, *self.parts])]).dropna(subset=["doc"])
        self._void(rows.select("doc"), no, segment)
        said = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), words(f"f_{f}").alias("words")) for f in self.fields]))
        fields = rows.select("doc", "recency", said.alias("s")).select("doc", "recency", "s.field", F.col("s.words").alias("words"))
        self._write(_postings(fields), "postings", "term", no, segment)
        shown = rows.select("doc", "recency", F.array(*[F.lower(F.coalesce(f"f_{f}", F.lit(""))) for f in self.parts]).cast("array<string>").alias("parts"))
        self._write(shown.select("doc", F.explode(F.array_distinct(F.flatten(F.transform("parts", pieces)))).alias("gram")), "grams", "gram", no, segment)
        shown.withColumns({"no": F.lit(no), "segment": F.lit(segment)}).write.mode("append").parquet(f"{self.path}/shown")
        self._commit(no, segment)

    def remove(self, keys: DataFrame) -> None:
        """Documents with these keys (the first column) are found no more."""
        no, segment = self._next()
        self._void(keys.select(F.col(keys.columns[0]).alias("doc")).dropna(), no, segment)
        self._commit(no, segment)

    def compact(self, path: str) -> SearchIndex:
        """The same documents as one segment of a new index in ``path``; the old one stays for its readers."""
        about = self.spark.read.parquet(f"{self.path}/about")
        about.write.parquet(f"{path}/about")
        made = SearchIndex.open(self.spark, path)
        no, segment = made._next()
        for what, term in (("postings", "term"), ("grams", "gram")):
            made._write(self._valid(self._table(what)).drop("bucket", "no", "segment"), what, term, no, segment)
        self._valid(self._table("shown")).withColumns({"no": F.lit(no), "segment": F.lit(segment)}).write.parquet(f"{path}/shown")
        made._void(self._table("shown").select("doc").limit(0), no, segment)
        made._commit(no, segment)
        return made

    def _write(self, rows: DataFrame, what: str, term: str, no: int, segment: str) -> None:
        dealt = rows.repartition(bucket(F.col(term)), F.pmod(F.xxhash64("doc"), F.lit(SPREAD))).withColumn("bucket", bucket(F.col(term))).sortWithinPartitions("bucket", term, "doc")
        dealt.withColumns({"no": F.lit(no), "segment": F.lit(segment)}).write.mode("append").partitionBy("bucket").parquet(f"{self.path}/{what}")

    def _void(self, keys: DataFrame, no: int, segment: str) -> None:
        """Notes the keys that older segments hold."""
        old = keys if no == 0 else keys.join(self._table("shown").select("doc").distinct(), "doc", "left_semi")
        (old.limit(0) if no == 0 else old.distinct()).select("doc", F.lit(no).alias("no"), F.lit(segment).alias("segment")).write.mode("append").parquet(f"{self.path}/gone")

    def _next(self) -> tuple[int, str]:
        return len(self._segments()), uuid.uuid4().hex

    def _commit(self, no: int, segment: str) -> None:
        self.spark.createDataFrame([(no, segment)], "no int, segment string").write.mode("append").parquet(f"{self.path}/segments")

    # --- reading ---

    def _segments(self) -> list[str]:
        """One per append since the index was last compacted."""
        jvm = self.spark._jvm
        there = jvm.org.apache.hadoop.fs.Path(f"{self.path}/segments")
        if not there.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(there):
            return []
        return [r["segment"] for r in self.spark.read.parquet(f"{self.path}/segments").orderBy("no").collect()]

    def _table(self, what: str) -> DataFrame:
        key, recency = self.kinds
        columns = {
            "postings": f"term string, field string, doc {key}, positions array<int>, recency {recency}, no int, segment string, bucket int",
            "grams": f"doc {key}, gram string, no int, segment string, bucket int",
            "shown": f"doc {key}, recency {recency}, parts array<string>, no int, segment string",
            "gone": f"doc {key}, no int, segment string",
        }
        return self.spark.read.schema(columns[what]).parquet(f"{self.path}/{what}").filter(F.col("segment").isin(self._segments()))

    def _valid(self, rows: DataFrame) -> DataFrame:
        """Rows of documents that no later segment replaced or removed."""
        gone = self._table("gone").groupBy(F.col("doc").alias("_doc")).agg(F.max("no").alias("_until"))
        return rows.join(gone, F.col("doc") == F.col("_doc"), "left").filter(F.col("_until").isNull() | (F.col("no") >= F.col("_until"))).drop("_doc", "_until")

    def postings(self) -> DataFrame:
        """term, field, doc, positions, recency of all documents that count."""
        return self._valid(self._table("postings")).select("term", "field", "doc", "positions", "recency")

    def _asked(self, terms: Column) -> tuple[list[str], list[int]]:
        found = self.spark.range(1).select(terms.alias("t")).select("t", F.transform("t", bucket).alias("b")).first()
        return list(found["t"]), sorted(set(found["b"]))

    def search(self, query: str, every: bool = True, phrase: bool = False, weights: dict[str, float] = WEIGHTS) -> DataFrame:
        """key, rank, recency of documents that hold every (or any) word of ``query``, or hold it as a part of a short field; best first by columns, unsorted.

        The rank sums, over words and fields, the weight of the field's class times n / (n + 1) for n occurrences. ``phrase``:
        the words must follow each other in one field. A document found by a part only has rank 0. Without words and with
        fewer than three characters nothing is found.
        """
        said, where = self._asked(words(F.lit(query)))
        weight = F.create_map(*[F.lit(x) for f, c in self.fields.items() for x in (f, weights[c])])[F.col("field")]
        wanted = list(dict.fromkeys(said))
        hits = self._valid(self._table("postings").filter(F.col("bucket").isin(where) & F.col("term").isin(wanted)))
        if phrase and len(said) > 1:
            held = hits.groupBy("doc").agg(F.collect_list(F.struct("field", "term", "positions", "recency")).alias("h"))
            follow = reduce(lambda a, b: a | b, (F.size(self._run(f, said)) > 0 for f in self.fields))
            hits = held.filter(follow).select("doc", F.inline("h"))
        n = F.size("positions")
        by_words = hits.groupBy("doc").agg(F.sum(weight * n / (n + 1)).alias("rank"), F.count_distinct("term").alias("n_terms"), F.max("recency").alias("recency"))
        if every:
            by_words = by_words.filter(F.col("n_terms") == len(wanted))
        found = by_words.select("doc", "rank", "recency")
        part = query.lower()
        if self.parts and len(part) >= 3:
            found = found.unionByName(self._by_part(part)).groupBy("doc").agg(F.max("rank").alias("rank"), F.max("recency").alias("recency"))
        return found.select(F.col("doc").alias(self.key), F.round("rank", 6).alias("rank"), "recency")

    @staticmethod
    def _run(field: str, said: list[str]) -> Column:
        """Where the words ``said`` follow each other in a field of a document whose postings are the array ``h``."""
        own = lambda w: F.flatten(F.transform(F.filter("h", lambda x: (x["field"] == field) & (x["term"] == w)), lambda x: x["positions"]))
        shifted = lambda w, i: F.transform(own(w), lambda x: x - i)
        return reduce(F.array_intersect, (shifted(w, i) for i, w in enumerate(said)))

    def _by_part(self, part: str) -> DataFrame:
        """Documents with ``part`` in a short field: those that have all its pieces, then those where it stands."""
        grams, where = self._asked(pieces(F.lit(part)))
        hits = self._table("grams").filter(F.col("bucket").isin(where) & F.col("gram").isin(grams))
        near = hits.groupBy("doc", "no").agg(F.count_distinct("gram").alias("n")).filter(F.col("n") == len(grams)).select("doc", "no")
        shown = self._valid(self._table("shown")).join(near, ["doc", "no"], "left_semi")
        return shown.filter(F.exists("parts", lambda p: F.contains(p, F.lit(part)))).select("doc", F.lit(0.0).alias("rank"), "recency")

    def best(self, query: str, most: int, **how) -> DataFrame:
        """The ``most`` best: by rank, then the latest, then the least key."""
        return self.search(query, **how).orderBy(F.desc("rank"), F.desc("recency"), self.key).limit(most)
