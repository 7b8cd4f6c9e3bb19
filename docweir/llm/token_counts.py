"""Token counts through a digest cache.

A cache row is (digest of the normalised text, digest of the tokenizer, count).
Texts whose digests are in the cache are not encoded again; of the others, each
different text is encoded once, where it lies if it surely occurs once, and its
count is appended to the cache.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweir.llm.filters import filter_of
from docweir.llm.words import slices
from docweir.session import materialise

#: Stretches without white space whose counts a Python worker keeps (about 150 bytes each).
MEMO_WORDS = 500_000
_SCHEMA = "text_digest string, tokenizer_digest string, n_tokens long"


def tokenizer_digest(path: str) -> str:
    """Digest of the vocabulary file and of the library that reads it."""
    import importlib.metadata
    library = "tokenizers" if path.endswith(".json") else "sentencepiece"
    with open(path, "rb") as file:
        return hashlib.sha256(file.read() + f"{library} {importlib.metadata.version(library)}".encode()).hexdigest()


def text_digest(text: str, path: str) -> Column:
    """Digest of a text as far as the tokenizer can tell texts apart; null counts as empty.

    Tokenizers that drop white space see only where it is, so each run of it
    becomes one space for them; for all others the text stays as it is.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    if drops_space(path):
        whole = F.trim(F.regexp_replace(whole, r"[\x20\x09-\x0D]+", " "))
    return F.sha2(whole.cast("binary"), 256)


def drops_space(path: str) -> bool:
    """Whether a vocabulary file's splitting rule removes white space, so that what lies between is encoded by itself."""
    if not path.endswith(".json"):
        return False
    import json
    with open(path, encoding="utf-8") as file:
        rules = json.load(file).get("pre_tokenizer") or {}
    first = (rules.get("pretokenizers") or [rules])[0]
    return first.get("type") == "Split" and first.get("behavior") == "Removed" and bool(first.get("invert"))


class Counter:
    """Counts the tokens of whole texts with the library of a vocabulary file."""

    def __init__(self, path: str):
        self._memo: dict[bytes, int] | None = None
        if path.endswith(".json"):
            os.environ["TOKENIZERS_PARALLELISM"] = "false"    # a task has one core
            from tokenizers import Tokenizer
            own = Tokenizer.from_file(path)
            own.no_truncation()
            own.no_padding()
            self._count = lambda texts: [len(x.ids) for x in own.encode_batch_fast(texts, add_special_tokens=False)]
            if drops_space(path):
                self._memo = {}
        else:
            import sentencepiece
            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self._count = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]

    def counts(self, texts: list[str]) -> list[int]:
        """One count for each text."""
        if self._memo is None:
            return self._count(texts)
        memo = self._memo
        split = [x.encode().split() for x in texts]
        new = list({w for words in split for w in words}.difference(memo))
        if len(memo) + len(new) > MEMO_WORDS:
            memo.clear()
            new = list({w for words in split for w in words})
        memo.update(zip(new, self._count([w.decode() for w in new])))
        sums = [sum(map(memo.__getitem__, words)) for words in split]
        for w in new:
            if len(w) > 64:    # long stretches are not worth their memory
                del memo[w]
        return sums


_loaded: dict[str, Counter] = {}


def _encoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _loaded:
            _loaded[path] = Counter(path)
        own = _loaded[path]
        for part in slices(batches, "text", 1 << 20):
            yield pa.RecordBatch.from_arrays(
                [part.column("digest"), pa.array(own.counts([x or "" for x in part.column("text").to_pylist()]), pa.int64())],
                names=["text_digest", "n_tokens"])
    return run


def _exists(spark, path: str) -> bool:
    """Whether a cache was ever written to ``path``, on whatever file system."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)


def read_cache(spark, path: str, tokenizer: str) -> DataFrame:
    """Digests and counts of one tokenizer, one row for each digest."""
    if not _exists(spark, path):
        return spark.createDataFrame([], "text_digest string, n_tokens long")
    rows = spark.read.schema(_SCHEMA).parquet(path).where(F.col("tokenizer_digest") == tokenizer)
    return rows.groupBy("text_digest").agg(F.max("n_tokens").alias("n_tokens"))


def token_counts(docs: DataFrame, vocabulary: str, cache: str, id_col: str = "doc_id", text: str = "text",
                 limit: int = 2048) -> DataFrame:
    """Number of tokens of every whole text, through the cache in the folder ``cache``.

    Columns: ``doc_id, n_bytes, n_tokens, over_limit``; one row for each row of
    ``docs``.  Null counts as the empty text, which has no tokens of its own.
    Counts are those of the library without added special tokens; special strings
    inside a text are handled as it does by default.  Null and repeated ids are
    kept.  Other columns are not read.  An empty table gives an empty result and
    leaves the cache as it is.

    Texts are shuffled only where they may be repeated or cached (decided by
    bounded filters); digests always.  Two runs that append the same digest at once
    do no harm: equal digests have equal counts.
    """
    spark, own = docs.sparkSession, tokenizer_digest(vocabulary)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"),
                       text_digest(text, vocabulary).alias("digest"))
    narrow = materialise(rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "digest"), "token-digests")
    known = read_cache(spark, cache, own)
    groups = materialise(narrow.groupBy("digest").agg(F.count("*").alias("times"))
                         .join(known.withColumnRenamed("text_digest", "digest"), "digest", "left"), "token-groups")
    aside = groups.where("times > 1 OR n_tokens IS NOT NULL").select(F.xxhash64("digest").alias("key"))
    doubtful = filter_of(aside, aside.count()).test(F.xxhash64("digest"))
    marked = rows.select("text", "digest").withColumn("_aside", doubtful)
    missing = groups.where("n_tokens IS NULL").select("digest")
    # Surely once and surely not cached: encoded where they lie.  The rest, once for each missing digest.
    alone = marked.where(~F.col("_aside")).select("digest", "text")
    rest = (marked.where("_aside").groupBy("digest").agg(F.first("text").alias("text"))
            .join(missing, "digest", "left_semi"))
    coded = (alone.mapInArrow(_encoded(vocabulary), "text_digest string, n_tokens long")
             .unionByName(rest.select("digest", "text").mapInArrow(_encoded(vocabulary), "text_digest string, n_tokens long")))
    coded.select("text_digest", F.lit(own).alias("tokenizer_digest"), "n_tokens").write.mode("append").parquet(cache)

    counted = read_cache(spark, cache, own)
    # The join has a key of its own on both sides, so that a hot digest can be split.
    counted = counted.select(F.reverse("text_digest").alias("_key"), "n_tokens")
    return (narrow.withColumn("_key", F.reverse("digest")).join(counted, "_key")
            .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")))
