"""Secret scan with corpus-wide ownership: who else holds the same string decides whether it looks live."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

# Fixed patterns: kind, pattern, group holding the value, least length of the value.
BASE = (
    ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"(AKIA[A-Z0-9]+)", 1, 18),
    ("hex", r"([0-9a-f]{16,})", 1, 16),
)
#: A longer run of key characters that holds digits, capitals and small letters: a candidate of no known form.
OPEN = ("open", r"([A-Za-z0-9+/_-]{24,})", 1, 24)
KINDS = ("assign", "access", "hex", "example", "live")


def _spans(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """Array of (start, rank, kind, end, value): start and end in code points, by the texts between the matches.

    Most texts hold no match; one search tells them, and only the others are cut up.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern if group == 1 else f"({pattern})"), F.lit(1))
    value = whole if group == 1 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    lengths = F.transform(F.arrays_zip(F.split(text, pattern, -1).alias("gap"), whole.alias("hit"), value.alias("value")),
                          lambda x: F.struct(F.length(x["gap"]).alias("gap"), F.length(x["hit"]).alias("hit"), x["value"].alias("value")))
    rank = KINDS.index(kind) if kind in KINDS else len(KINDS)
    none = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int,value:string>>")
    seen = F.struct(F.lit(0).alias("at"), none.alias("found"))

    def step(acc, x):
        start = acc["at"] + x["gap"]
        end = start + F.coalesce(x["hit"], F.lit(0))
        hit = F.struct(start.alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), end.alias("end"), x["value"].alias("value"))
        found = F.when(F.length(x["value"]) >= least, F.concat(acc["found"], F.array(hit))).otherwise(acc["found"])
        return F.struct(end.alias("at"), found.alias("found"))

    return F.when(text.rlike(pattern), F.aggregate(lengths, seen, step, lambda acc: acc["found"])).otherwise(none)


def candidates(documents: DataFrame, text: str = "text") -> DataFrame:
    """Add ``found``: the base spans and, of kind open, long mixed strings; null text counts as empty."""
    body = F.coalesce(F.col(text), F.lit(""))
    mixed = F.filter(_spans(body, *OPEN), lambda x: x["value"].rlike("[0-9]") & x["value"].rlike("[a-z]") & x["value"].rlike("[A-Z]"))
    return documents.withColumn("found", F.concat(*[_spans(body, *b) for b in BASE], mixed))


def ownership(found: DataFrame, example_owners: int = 3) -> DataFrame:
    """One row per candidate hash that more than one owner or repository holds: counts and the class.

    ``found`` has a row per occurrence: hash, owner, repository. Rows are reduced to one per (hash, owner,
    repository) and then per (hash, owner) with map-side aggregation, so a string that stands in a third of all
    documents is a few rows when its hash is grouped.
    """
    by_owner = found.groupBy("hash", "owner", "repository").count().groupBy("hash", "owner").agg(
        F.count("*").alias("repositories"), F.sum("count").alias("places"))
    return (by_owner.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"),
                                         F.sum("places").alias("places"))
            .where("owners > 1 or repositories > 1")
            .withColumn("class", F.when(F.col("owners") >= example_owners, "example")
                        .when(F.col("owners") == 1, "live").otherwise("shared")))


def scan(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", owner: Column | str = "source",
         repository: Column | str | None = None, example_owners: int = 3, salts: int = 16) -> DataFrame:
    """One row per document: ``doc_id`` and ``found``, its spans in order, with value and class in place.

    A candidate held by one owner only is live-looking; one that at least ``example_owners`` owners hold is a
    copied example; between the two it is neither. Null owners and repositories are owners and repositories of
    their own. Base spans stay whatever their class; each classed candidate adds a span of kind live or example.
    The lookup of classes is salted on the side of the documents, since one string may stand in a third of them.
    """
    owner = F.col(owner) if isinstance(owner, str) else owner
    repository = owner if repository is None else F.col(repository) if isinstance(repository, str) else repository
    rows = stored(candidates(documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), owner.alias("owner"),
                                              repository.alias("repository")))
                  .select("doc_id", "owner", "repository", F.monotonically_increasing_id().alias("row"), "found"))
    each = (rows.select("doc_id", "row", "owner", "repository", F.explode_outer("found").alias("x"))
            .withColumn("hash", F.coalesce(F.sha2("x.value", 256), F.col("row").cast("string"))))
    classes = (ownership(each.where("x is not null").select("hash", "owner", "repository"), example_owners)
               .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).select("hash", "salt", "class"))
    known = (each.withColumn("salt", F.pmod("row", F.lit(salts)).cast("int")).join(classes, ["hash", "salt"], "left")
             .withColumn("class", F.when(F.col("x").isNotNull(), F.coalesce("class", F.lit("live")))))
    base = F.when(F.col("x.kind") != "open", F.array("x"))
    added = F.when(F.col("class").isin("example", "live"), F.array(F.struct(
        F.col("x.start").alias("start"), F.when(F.col("class") == "example", F.lit(KINDS.index("example"))).otherwise(F.lit(KINDS.index("live"))).alias("rank"),
        F.col("class").alias("kind"), F.col("x.end").alias("end"), F.col("x.value").alias("value"))))
    none = F.array().cast(known.select(F.array("x")).schema[0].dataType)
    return (known.withColumn("spans", F.concat(F.coalesce(base, none), F.coalesce(added, none)))
            .groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("found"))
            .drop("row"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def secret_table(documents: DataFrame) -> DataFrame:
    """One row per document with counts of the base spans, their digest, and all spans."""
    found = scan(documents, repository=F.concat_ws("/", "source", "lang"))
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"),
                        F.sha2(_joined(F.filter("found", lambda x: x["rank"] < 3)), 256).alias("base_sha256"),
                        _joined(F.col("found")).alias("spans"))
