"""Lines in, ledger rows out: parsing, validation, deduplication, idempotency, monthly shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.functions.ids import canonical_uuid, instant
from recordloom.session import get_text, list_files, open_tail

ENVELOPE = (
    "id string, namespace string, type string, actor string, recorded_at string, observed_at string, valid_at string, payload string, "
    "evidence array<struct<kind:string,reference:string,sha256:string>>, tags array<string>, supersedes string"
)
TYPE_NAME = r"^([a-z0-9-]+\.){2,}v[0-9]+$"
NAMESPACE = r"^[a-z0-9][a-z0-9-]*(\.[a-z0-9][a-z0-9-]*)*$"
POINTER = r"^(/([^~/]|~[01])*)*$"
SHA256 = "^[0-9a-f]{64}$"


class BrokenLedger(ValueError):
    """A ledger that does not verify is not read at all."""


def read_lines(spark: SparkSession, path: str, whole_only: bool = False) -> DataFrame:
    """line, sha256, file of every non-blank line of JSONL files.

    ``whole_only`` leaves out the last line of a file if no line end follows it:
    a writer is, or was, in the middle of it (``torn_tails``).
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_name").alias("file"))
    if whole_only:
        for f, tail in torn_tails(spark, path).items():  # one a file, and hardly any
            lines = lines.where(~((F.col("_path").endswith(f)) & (F.col("value") == tail)))
    return lines.where(F.trim("value") != "").select(F.col("value").alias("line"), F.sha2("value", 256).alias("sha256"), "file")


def torn_tails(spark: SparkSession, path: str) -> dict[str, str]:
    """Files of a folder whose last line is not ended, with what stands of it; only the ends of the files are read."""
    tails = {f.split(":", 1)[-1].lstrip("/"): open_tail(spark, f, length) for f, (length, _) in list_files(spark, path).items()}
    return {f: t for f, t in tails.items() if t}


def read_ledger(spark: SparkSession, path: str, verify: bool = True, whole_only: bool = False) -> DataFrame:
    """The canonical scan: every line an envelope, ids unique; fails closed. ``whole_only`` as in ``read_lines``."""
    rows = read_lines(spark, path, whole_only).withColumn("r", F.from_json("line", ENVELOPE + ", _broken string", {"columnNameOfCorruptRecord": "_broken"}))
    out = rows.select("r.*", "sha256", "file")
    if verify:
        bad = out.where(F.col("_broken").isNotNull() | F.col("id").isNull() | F.col("namespace").isNull() | F.col("type").isNull()).limit(1).count()
        if bad:
            raise BrokenLedger("a line is no record")
        if out.groupBy("id").count().where("count > 1").limit(1).count():
            raise BrokenLedger("an id stands on two lines")
    return out.drop("_broken")


def write_ledger(view: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One folder of JSONL files a month of recording; files are committed whole or not at all."""
    month = F.date_format(instant(F.col("recorded_at")), "yyyy-MM")
    line = F.to_json(F.struct("id", "namespace", F.col("type_name").alias("type"), "actor", "recorded_at", "observed_at", "valid_at", "payload", F.from_json("evidence", "array<struct<kind:string,reference:string,sha256:string>>").alias("evidence"), F.from_json("tags", "array<string>").alias("tags"), "supersedes"))
    view.select(line.alias("value"), month.alias("month")).repartition("month", F.pmod(F.xxhash64("value"), F.lit(8))).write.mode(mode).partitionBy("month").text(path)


def read_shards(spark: SparkSession, path: str, months: list[str]) -> DataFrame:
    """Lines of the named months only: other folders are not opened."""
    return spark.read.text(path).where(F.col("month").cast("string").isin(months)).select(F.col("value").alias("line"), "month")


def import_plan(lines: DataFrame, known_digests: DataFrame) -> DataFrame:
    """ordinal, sha256, action for (ordinal, sha256): import, known (already in the ledger) or repeated (in this batch).

    Ordinals are unique. The first of equal lines is found by a map-side minimum
    and marked by a join on digest and ordinal, so a line that makes up a third
    of the batch stays spread.
    """
    known = known_digests.select("sha256").distinct().withColumn("known", F.lit(True))
    first = lines.groupBy("sha256").agg(F.min("ordinal").alias("ordinal")).withColumn("first", F.lit(True))
    j = lines.join(first, ["sha256", "ordinal"], "left").join(known, "sha256", "left")
    return j.select("ordinal", "sha256", F.when(F.col("known"), "known").when(F.col("first"), "import").otherwise("repeated").alias("action"))


def resolve_supersedes(lines: DataFrame, id_map: DataFrame, known_ids: DataFrame) -> DataFrame:
    """ordinal, target, resolved: a legacy id through the map first, else an existing UUID; neither is an error row."""
    m = id_map.select(F.col("legacy").alias("target"), F.col("id").alias("mapped"))
    k = known_ids.select(F.col("id").alias("uuid"), F.lit(True).alias("there"))
    j = lines.withColumn("uuid", canonical_uuid(F.col("target"))).join(m, "target", "left").join(k, "uuid", "left")
    found = F.coalesce("mapped", F.when(F.col("there"), F.col("uuid")))
    return j.select("ordinal", "target", found.alias("resolved"), (F.col("target").isNotNull() & found.isNull()).alias("failed"))


def replay(requests: DataFrame, done: DataFrame) -> DataFrame:
    """ordinal, verdict for keyed writes: new, replay (same key, same draft) or conflict (same key, another draft).

    Both sides: actor, key, draft_sha256. Within a batch the first request of a key counts as done.
    """
    d = done.groupBy("actor", "key").agg(F.min("draft_sha256").alias("done_sha"))
    first = requests.groupBy("actor", "key").agg(F.min(F.struct("ordinal", "draft_sha256")).alias("f"))
    judge = first.join(d, ["actor", "key"], "left").select("actor", "key", F.col("f.ordinal").alias("first_ordinal"), F.coalesce("done_sha", "f.draft_sha256").alias("sha"), F.col("done_sha").isNull().alias("fresh"))
    j = requests.join(judge, ["actor", "key"])
    return j.select("ordinal", F.when(F.col("fresh") & (F.col("ordinal") == F.col("first_ordinal")), "new").when(F.col("draft_sha256") == F.col("sha"), "replay").otherwise("conflict").alias("verdict"))


def validity(view: DataFrame) -> DataFrame:
    """id and the first fault of each record that breaks a rule of form; sound records give no row."""
    fault = (
        F.when(F.col("namespace").isNull() | ~F.col("namespace").rlike(NAMESPACE), "namespace").when(F.col("type_name").isNull() | ~F.col("type_name").rlike(TYPE_NAME), "type_name")
        .when(F.col("actor").isNull() | (F.trim("actor") == "") | F.col("actor").rlike(r"\p{Cc}"), "actor").when(~F.coalesce(F.col("record_sha256").rlike(SHA256), F.lit(False)), "record_sha256")
        .when(instant(F.col("recorded_at")).isNull(), "recorded_at").when(F.col("payload").isNull(), "payload").when(F.col("tags").isNull(), "tags").when(F.col("evidence").isNull(), "evidence")
    )
    return view.select("id", fault.alias("fault")).where(F.col("fault").isNotNull())


def word_count(c: Column) -> Column:
    """Words between Unicode white space; 0 for null."""
    return F.size(F.filter(F.split(F.coalesce(c, F.lit("")), r"[\s\p{Z}\x{85}]+"), lambda w: w != ""))


def over_word_limit(view: DataFrame, limits: dict[tuple[str, str], int]) -> DataFrame:
    """id, field, words over the limit for (type_name, payload field) -> most words; other types are free."""
    out: DataFrame | None = None
    for (t, f), most in sorted(limits.items()):
        words = word_count(F.get_json_object("payload", f"$.{f}"))
        part = view.where(F.col("type_name") == t).select("id", F.lit(f).alias("field"), words.cast("long").alias("words")).where(F.col("words") > most)
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no limits given")
    return out


def read_manifest(spark: SparkSession, path: str) -> list[dict]:
    """Inputs of an import: JSONL of path, role, expiry and anchor resolver; a path may stand there once."""
    import json

    out: list[dict] = []
    for n, line in enumerate(get_text(spark, path).split("\n"), 1):
        if not line.strip():
            continue
        entry = json.loads(line)
        if not isinstance(entry, dict) or not isinstance(entry.get("path"), str) or not entry["path"]:
            raise ValueError(f"line {n} names no path")
        if unknown := set(entry) - {"path", "role", "expiry", "anchor_resolver"}:
            raise ValueError(f"line {n} has unknown fields {sorted(unknown)}")
        if any(e["path"] == entry["path"] for e in out):
            raise ValueError(f"line {n} repeats {entry['path']}")
        if entry.get("expiry") is not None:
            entry["expiry"] = {"warning_days": 30} | entry["expiry"]
        out.append(entry)
    return out


def is_batch(spark: SparkSession, path: str) -> bool:
    """Whether a draft file holds several drafts, one a line, rather than one JSON document; decided by Spark, so the file may be large."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    first = lines.limit(2).collect()
    if len(first) < 2 or not all(r[0].lstrip().startswith("{") for r in first):
        return False
    broken = F.try_parse_json("value").isNull() | ~F.ltrim("value").startswith("{")
    return lines.where(broken).limit(1).count() == 0 or spark.read.text(path, wholetext=True).where(F.try_parse_json("value").isNotNull()).limit(1).count() == 0


def verify_receipts(receipt_lines: DataFrame, ledger_digests: DataFrame) -> DataFrame:
    """Lines an import receipt claims that no record's evidence names: each is an integrity fault."""
    return receipt_lines.join(ledger_digests.select("sha256"), "sha256", "left_anti")


def kept_keys(done: DataFrame, kept: DataFrame) -> DataFrame:
    """Idempotency keys whose record survived a compaction, with the record's digest as it is now."""
    return done.drop("record_sha256").join(kept.select("id", "record_sha256"), "id")
