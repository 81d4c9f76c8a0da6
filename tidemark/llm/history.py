"""Problem 4: new batches against all history.

The store keeps, of everything accepted so far, winnowed fingerprints, digests, content hashes, record names and Bloom
filters in a folder that outlives the session. Every entry lies in a bucket by the hash of its key, a bucket holding
PER_BUCKET keys however long the history, so what a batch reads follows the batch: Bloom words of the buckets its keys
fall in; then the entries of only those buckets that hold a key the filter lets through; then the digests of candidates,
again by bucket; hits are verified on the whole digests. A batch that touches every bucket reads each once, never more.

A Bloom filter is a table of 64-bit words. A key belongs to one word (a partition of the filter) and sets
BITS bits there; it may have arrived before if all of them are set. Each update is a generation, a folder of its own
that adds words and entries and rewrites none; it counts once the store's description names it, so an update that was
cut short leaves nothing behind. When entries have doubled, generations are merged into one with more buckets,
which costs a constant share an entry.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.digest import PARTS, distance, length_value
from tidemark.functions.keys import instant
from tidemark.llm import winnow
from tidemark.llm.records import CLASS, fingerprints
from tidemark.session import Scratch, remove

BITS = 4
WITHIN = 10
PER_BUCKET = 1 << 19
#: Keys of a batch, of up to 40 bytes, that may be broadcast to the buckets they are looked up in: about 25 MB as a table.
FEW = 1 << 18

FINGERPRINT, DIGEST, CONTENT, RECORD, WORD = range(5)
SCREENED = (FINGERPRINT, CONTENT, RECORD)
COLUMNS = "key long, id long, head int, h0 long, h1 long, l0 long, l1 long"


class HistoryStore:
    """Fingerprints, digests, contents, record names and Bloom words of all accepted records, in a folder.

    An entry is (kind, key, id, digest): a fingerprint's key is itself, a digest's its id, a content's or record's the first
    half of a 128-bit hash (see names) with the second as id, and a Bloom word's its number, with the bits set in h0. Files lie in
    gen=G/kind=K/bucket=B. path: a folder of its own in the shared file system; what an earlier session left there
    is opened. One writer at a time. per_bucket: keys a bucket is made for; about 12 bits of filter belong to each.
    """

    def __init__(self, spark: SparkSession, path: str, per_bucket: int = PER_BUCKET):
        self.spark, self.path = spark, path
        self._jvm_path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._jvm_path(path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._lists: dict[tuple[str, int], set[int]] = {}
        found = sorted(n for n in self._names(path) if n.startswith("store-") and n.endswith(".json"))
        if found:
            stream = self._fs.open(self._jvm_path(f"{path}/{found[-1]}"))
            self.about = json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            stream.close()
        else:
            words = max(1, per_bucket * 12 // 64)
            self.about = {"version": 0, "per_bucket": per_bucket, "words": words, "buckets": 0, "entries": 0, "merged": 0, "batches": 0, "generations": []}
        #: What the last reads took: kind -> buckets.
        self.read: dict[int, list[int]] = {}

    def _names(self, path: str) -> list[str]:
        p = self._jvm_path(path)
        if not self._fs.exists(p):
            return []
        jvm = self.spark._jvm
        # One call for the whole list: a call an entry would take longer than reading it.
        text = jvm.org.apache.commons.lang3.ArrayUtils.toString(jvm.org.apache.hadoop.fs.FileUtil.stat2Paths(self._fs.listStatus(p)))[1:-1]
        return [x.rsplit("/", 1)[1] for x in text.split(",") if x]

    def _describe(self, **new) -> None:
        """Writes the description under the next number; the newest counts, and the one before it stays."""
        self.about = self.about | new | {"version": self.about["version"] + 1}
        name = lambda v: self._jvm_path(f"{self.path}/store-{v:09d}.json")
        draft = self._jvm_path(f"{self.path}/draft-{uuid.uuid4().hex}")
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps(self.about).encode()))
        out.close()
        if not self._fs.rename(draft, name(self.about["version"])):
            raise OSError(f"{self.path}: another writer has added version {self.about['version']}")
        self._fs.delete(name(self.about["version"] - 2), False)

    def place(self, key: Column) -> Column:
        """The number of a key's Bloom word; words // self.about["words"] is its bucket."""
        return F.pmod(F.xxhash64(key, F.lit(1)), F.lit(self.about["buckets"] * self.about["words"]))

    def bucket(self, key: Column) -> Column:
        return F.floor(self.place(key) / F.lit(self.about["words"])).cast("int")

    def entries(self, kind: int, buckets: list[int] | None = None) -> DataFrame:
        """The entries of a kind in some buckets (None: in all); other files are not even listed."""
        paths = []
        for g in self.about["generations"]:
            at = f"{self.path}/{g}/kind={kind}"
            if (g, kind) not in self._lists:
                self._lists[g, kind] = {int(n.split("=")[1]) for n in self._names(at) if n.startswith("bucket=")}
            have = self._lists[g, kind]
            mine = have if buckets is None else have & set(buckets)
            paths += [at] if mine and mine == have else [f"{at}/bucket={b}" for b in sorted(mine)]
        self.read[kind] = sorted(buckets) if buckets is not None else list(range(self.about["buckets"]))
        names = [c.split()[0] for c in COLUMNS.split(", ")]
        if not paths:
            return self.spark.createDataFrame([], COLUMNS)
        return self.spark.read.schema(COLUMNS).option("basePath", self.path).parquet(*paths).select(*names)

    def update(self, records: DataFrame, digests: DataFrame, fps: DataFrame, expected: int = 0) -> None:
        """Accept records (s1, s2, c1, c2 of names), distinct digests (CLASS) and their fingerprints (fp, id).

        expected: keys to come with the first update, for which buckets are laid out.
        """
        if not self.about["buckets"]:
            self.about["buckets"] = 1 << max(0, -(-expected // self.about["per_bucket"]) - 1).bit_length()
        named = lambda c, kind: rows(records.where(F.col(f"{c}1").isNotNull()).select(f"{c}1", f"{c}2").distinct(), kind, F.col(f"{c}1"), id=F.col(f"{c}2"))
        out = rows(fps, FINGERPRINT, F.col("fp"), id=F.col("id")).unionByName(rows(digests, DIGEST, F.col("id"), **{p: F.col(p) for p in PARTS}))
        self._write(out.unionByName(named("c", CONTENT)).unionByName(named("s", RECORD)), self.about["generations"])
        if self.about["entries"] > 2 * self.about["merged"] and len(self.about["generations"]) > 1:
            self.merge()

    def _write(self, out: DataFrame, after: list[str]) -> None:
        words = out.where(F.col("kind").isin(*SCREENED)).groupBy(self.place(F.col("key")).alias("word")).agg(F.bit_or(_mask(_bloomed())).alias("set"))
        seen = Observation()
        every = out.observe(seen, F.count(F.lit(1)).alias("n")).withColumn("bucket", self.bucket(F.col("key"))).unionByName(rows(words, WORD, F.col("word"), h0=F.col("set")).withColumn("bucket", F.floor(F.col("key") / F.lit(self.about["words"])).cast("int")))
        name = f"gen={len(after):05d}-{uuid.uuid4().hex[:8]}"
        # One file a kind and bucket. Hashes repeat too little for dictionaries.
        every.repartition("bucket").write.option("parquet.enable.dictionary", "false").partitionBy("kind", "bucket").parquet(f"{self.path}/{name}")
        entries = _taken(seen, out, F.count(F.lit(1)).alias("n"))["n"] + (self.about["entries"] if after else 0)
        self._describe(generations=[*after, name], entries=entries, merged=self.about["merged"] if after else entries)

    def merge(self) -> None:
        """One generation instead of all, with buckets for as many keys as there are now."""
        old = self.about["generations"]
        kept = [self.entries(k).withColumn("kind", F.lit(k)) for k in (FINGERPRINT, DIGEST, CONTENT, RECORD)]
        every = kept[0]
        for k in kept[1:]:
            every = every.unionByName(k)
        self.about["buckets"] = 1 << max(0, -(-self.about["entries"] // self.about["per_bucket"]) - 1).bit_length()
        self._write(every.distinct(), [])
        self._lists.clear()
        for g in old:
            remove(self.spark, f"{self.path}/{g}")

    def buckets_of(self, df: DataFrame, key: str, n: int) -> list[int] | None:
        """The buckets in which the n keys of a table fall; None (all) if there are at least 4 keys a bucket, as then few are spared."""
        if n >= 4 * self.about["buckets"]:
            return None
        return sorted(r[0] for r in df.select(self.bucket(F.col(key))).distinct().collect())  # fewer than n

    def screen(self, probes: DataFrame, n: int) -> DataFrame:
        """The probes (kind, key and other columns; about n) that the Bloom words of some generation do not rule out."""
        words = self.entries(WORD, self.buckets_of(probes, "key", n)).select(F.col("key").alias("word"), F.col("h0").alias("set"))
        asked = probes.withColumn("word", self.place(F.col("key"))).withColumn("mask", _mask(_bloomed()))
        return _small(asked, n).join(words, "word").where(F.col("set").bitwiseAND(F.col("mask")) == F.col("mask")).select(*probes.columns)

    def lookup(self, hits: DataFrame, kind: int, n: int, key: str = "key") -> DataFrame:
        """A table of n keys joined with the entries of a kind; entry columns as e_key, e_id and so on."""
        have = self.entries(kind, self.buckets_of(hits, key, n))
        return _small(hits, n).join(have.select(*(F.col(c).alias(f"e_{c}") for c in have.columns)), F.col(key) == F.col("e_key"))


def rows(df: DataFrame, kind: int, key: Column, **have: Column) -> DataFrame:
    """Entries of a kind."""
    types = dict(c.split() for c in COLUMNS.split(", ")[1:])
    return df.select(F.lit(kind).alias("kind"), key.alias("key"), *(have.get(n, F.lit(None)).cast(t).alias(n) for n, t in types.items()))


def names(df: DataFrame) -> DataFrame:
    """df with 128-bit hashes, as two longs, of sha (s1, s2) and content (c1, c2; null where it is null).

    That two of 10^10 names agree in 128 bits by chance has a probability of about 10^-19.
    """
    half = lambda c, *seed: F.when(F.col(c).isNotNull(), F.xxhash64(c, *seed))
    return df.select("*", *(half(c, *seed).alias(f"{k}{i}") for k, c in (("s", "sha"), ("c", "content")) for i, seed in ((1, ()), (2, (F.lit(11),)))))


def _small(df: DataFrame, n: int) -> DataFrame:
    """df of n rows for a join: broadcast if they are few, else built into hash tables where they are shuffled to."""
    return F.broadcast(df) if n <= FEW else df.hint("shuffle_hash")


def _bloomed() -> Column:
    return F.xxhash64("key", F.lit(7), F.col("kind").cast("int"))


def with_fingerprints(digests: DataFrame, keep: list[str]) -> DataFrame:
    """keep, fp, own: the fingerprints of digests in each band of length values they may be asked for; own: their own band."""
    return winnow.banded(winnow.kept(digests, [*keep, "head"]), "head", 1, True).select(*keep, F.col("key").alias("fp"), (F.shiftright("key", 40) == F.shiftright(length_value(F.col("head")), 3)).alias("own"))


def _mask(h: Column) -> Column:
    out = None
    for i in range(BITS):
        one = F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int"))
        out = one if out is None else out.bitwiseOR(one)
    return out


def first_deliveries(batches: DataFrame) -> DataFrame:
    """One row a record: sha, content, id, digest, batch_no and at = (timestamp, sha) of its first delivery.

    The first delivery has the least (batch_no, timestamp); a null batch or timestamp comes last. Rows of the
    same delivery that differ are settled in favour of one with a content hash and a usable digest.
    """
    rows = fingerprints(batches, F.coalesce(F.col("batch_no"), F.lit(2**31 - 1)).alias("batch_no"), F.coalesce(instant("timestamp"), F.timestamp_micros(F.lit(253402300799000000))).alias("ts"))
    order = F.struct("batch_no", "ts", F.col("id").isNull().alias("x"), F.col("content").isNull().alias("y"), "content", "id")
    one = rows.groupBy("sha").agg(F.min_by(F.struct("content", "id", *PARTS, "batch_no", "ts"), order).alias("r"))
    return one.select("sha", "r.*").withColumn("at", F.struct("ts", "sha"))


def with_copies(records: DataFrame) -> DataFrame:
    """records with copy: an earlier record of the same batch, by (timestamp, sha), has the same digest or content."""

    def firsts(*k: str) -> DataFrame:
        f = records.where(F.col(k[0]).isNotNull()).groupBy("batch_no", *k).agg(F.min("at").alias(f"_{k[0]}"))
        return f.hint("merge")

    marked = records.join(firsts(*CLASS), ["batch_no", *CLASS], "left").join(firsts("content"), ["batch_no", "content"], "left")
    later = lambda k: F.coalesce(F.col("at") > F.col(f"_{k}"), F.lit(False))
    return marked.select(*records.columns, (later("id") | later("content")).alias("copy"))


def batch_classes(records: DataFrame) -> DataFrame:
    """batch_no, CLASS, first_at: the distinct digests of each batch; first_at is the least (timestamp, sha)."""
    return records.where("id IS NOT NULL").groupBy("batch_no", *CLASS).agg(F.min("at").alias("first_at"))


def _near() -> Column:
    return distance({p: F.col(p) for p in PARTS}, {p: F.col(f"r_{p}") for p in PARTS})


def close_within(classes: DataFrame, fps: DataFrame, within: int = WITHIN) -> DataFrame:
    """batch_no, CLASS of digests to which an earlier record of another digest of the same batch is close."""
    asked = fps.where("own").select("batch_no", "fp", "id")
    pairs = asked.join(fps.select("batch_no", "fp", F.col("id").alias("ref")).hint("merge"), ["batch_no", "fp"]).select("batch_no", "id", "ref").distinct()
    theirs = classes.select("batch_no", F.col("id").alias("ref"), F.col("first_at").alias("r_at"), *(F.col(p).alias(f"r_{p}") for p in PARTS))
    both = pairs.join(theirs.hint("merge"), ["batch_no", "ref"]).join(classes.hint("merge"), ["batch_no", "id"])
    # A class is no earlier than itself, so it does not meet itself here.
    return both.where((F.col("r_at") < F.col("first_at")) & (_near() <= within)).select("batch_no", *CLASS).distinct()


def _counted(scratch: Scratch, df: DataFrame, name: str, **counts: Column) -> tuple[DataFrame, dict]:
    """df written, and how many rows meet each condition, counted on the way."""
    seen, cols = Observation(), [F.coalesce(F.count_if(c), F.lit(0)).alias(k) for k, c in counts.items()]
    out = scratch.cut(df.observe(seen, *cols), name)
    return out, _taken(seen, out, *cols)


def _taken(seen: Observation, df: DataFrame, *cols: Column) -> dict:
    """What was observed; a plan that Spark found to be empty is not observed and counted here."""
    try:
        return seen.get
    except Py4JJavaError:
        return df.agg(*cols).first().asDict()


def against_store(batch: DataFrame, classes: DataFrame, fps: DataFrame, n: int, store: HistoryStore, scratch: Scratch, within: int = WITHIN) -> DataFrame:
    """What of a batch of about n records repeats the store: rows of CLASS (a digest that is close to one of the
    store's) or c1, c2 (a content the store has).

    Of records of one digest (or one content) in a batch only the first can be new; so classes are compared, and a
    digest that a third of the batch shares is one class.
    """
    if within > WITHIN:
        raise ValueError(f"the windows find all records up to distance {WITHIN}")
    asked = fps.where("own").select(F.lit(FINGERPRINT).alias("kind"), F.col("fp").alias("key"), "id")
    contents = batch.where("c1 IS NOT NULL").select("c1", "c2").distinct()
    probes = asked.unionByName(contents.select(F.lit(CONTENT).alias("kind"), F.col("c1").alias("key"), F.col("c2").alias("id")))
    hits, got = _counted(scratch, store.screen(probes, 12 * n).distinct(), "hits", fps=F.col("kind") == FINGERPRINT, contents=F.col("kind") == CONTENT)
    past = store.lookup(hits.where(F.col("kind") == FINGERPRINT), FINGERPRINT, got["fps"]).select(F.col("e_id").alias("ref"), "id").distinct()
    past, pairs = _counted(scratch, past, "candidates", n=F.lit(True))
    old = store.lookup(past, DIGEST, pairs["n"], "ref").select("id", *(F.col(f"e_{p}").alias(f"r_{p}") for p in PARTS))
    close = old.join(classes.hint("merge"), "id").where(_near() <= within).select(*CLASS).distinct()
    same = store.lookup(hits.where(F.col("kind") == CONTENT), CONTENT, got["contents"]).where("id = e_id").select(F.col("key").alias("c1"), F.col("id").alias("c2")).distinct()
    none = lambda c: F.lit(None).cast(dict(x.split() for x in COLUMNS.split(", ")).get(c, "long")).alias(c)
    return close.select(*CLASS, none("c1"), none("c2")).unionByName(same.select(*(none(c) for c in CLASS), "c1", "c2"))


def arrived(store: HistoryStore, records: DataFrame, scratch: Scratch) -> DataFrame:
    """records without those whose sha the store has from an earlier call."""
    probes = records.select(F.lit(RECORD).alias("kind"), F.col("s1").alias("key"), F.col("s2").alias("id"))
    hits, got = _counted(scratch, store.screen(probes, records.count()), "seen", n=F.lit(True))
    seen = store.lookup(hits, RECORD, got["n"]).where("id = e_id").select(F.col("key").alias("s1"), F.col("id").alias("s2")).distinct()
    return records.join(seen.hint("merge"), ["s1", "s2"], "left_anti")


def ingest(store: HistoryStore, history: DataFrame, scratch: Scratch) -> None:
    """Accept a table of fingerprints as history, unchecked."""
    past = scratch.cut(names(fingerprints(history)).select("s1", "s2", "c1", "c2", *CLASS), "history")
    digests = scratch.cut(past.where("id IS NOT NULL").select(*CLASS).distinct(), "digests")
    # Up to 13 fingerprints a digest with the neighbouring bands, and a digest, content and name.
    store.update(past, digests, with_fingerprints(digests, ["id"]), past.count() * 3 + digests.count() * 13)


def run_batches(history: DataFrame | None, batches: DataFrame, scratch: Scratch, within: int = WITHIN, store: HistoryStore | None = None) -> DataFrame:
    """batch_no, sha: for each arrival batch the records that repeat history or an earlier record, exactly or nearly.

    history (None: none to add) is ingested once; batches follow in order of batch_no, each checked and then added. Later
    deliveries of a record neither are cases nor count as earlier records, also where the first one came in an earlier
    call with the same store. store: one that lasts; without it a new store is made in the scratch folder. Nulls: see
    first_deliveries; a null content equals nothing and an unusable digest gives no distance. Empty batches give no
    rows; an empty history is allowed.
    """
    store = store or HistoryStore(scratch.spark, f"{scratch.path}/store-{uuid.uuid4().hex[:8]}")
    earlier = store.about["batches"] > 0
    if history is not None:
        ingest(store, history, scratch)
    records = names(first_deliveries(batches))
    if earlier:
        records = arrived(store, scratch.cut(records, "deliveries"), scratch)
    arrivals = scratch.cut(with_copies(records), "arrivals", "batch_no")
    classes = scratch.cut(batch_classes(arrivals), "classes", "batch_no")
    fps = scratch.cut(with_fingerprints(classes, ["batch_no", "id"]), "fingerprints", "batch_no")
    numbers = dict(arrivals.groupBy("batch_no").count().collect())  # one row a batch
    found = []
    for b in sorted(numbers):
        # A batch has its own folders: other batches are not read.
        mine = [t.where(F.col("batch_no") == b).drop("batch_no") for t in (arrivals, classes, fps)]
        found.append(scratch.cut(against_store(*mine, numbers[b], store, scratch, within).withColumn("batch_no", F.lit(b)), "repeats"))
        store.about["batches"] += 1
        store.update(mine[0], mine[1].select(*CLASS), mine[2].select("fp", "id"), numbers[b] * 16)
    if not found:
        return scratch.spark.createDataFrame([], "batch_no int, sha string")
    repeats = scratch.tables(found)
    close = repeats.where("id IS NOT NULL").select("batch_no", *CLASS).unionByName(close_within(classes, fps, within))
    same = repeats.where("c1 IS NOT NULL").select("batch_no", "c1", "c2")
    cases = arrivals.join(close.hint("merge"), ["batch_no", *CLASS], "left_semi").unionByName(arrivals.join(same.hint("merge"), ["batch_no", "c1", "c2"], "left_semi").select(arrivals.columns))
    return cases.unionByName(arrivals.where("copy")).select("batch_no", "sha").distinct()
