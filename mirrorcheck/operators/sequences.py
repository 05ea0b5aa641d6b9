"""Event sequences: building, cleaning, auditing and reading back token arrays; shifting dates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import hash_uniform, ratio, union_all
from ..functions.ordered import exact_quantiles
from ..functions.session import pieces, stable

# Markers of the token language, the length limit and the death concepts of the audit.
VISIT_START, VISIT_END = "[VS]", "[VE]"
MAX_TOKENS = 1024
DEATH_CONCEPTS = ("4306655", "4304866", "4267568", "443768")


def match_rate(linked: DataFrame, id_col: str = "visit_occurrence_id") -> DataFrame:
    """Rows, rows with a visit and their percent."""
    return linked.agg(F.count("*").alias("n_rows"), F.count(id_col).alias("n_matched")).withColumn(
        "match_pct", ratio(100 * F.col("n_matched"), F.col("n_rows")))


def qualified_concepts(tables: Sequence[tuple[DataFrame, str]], min_persons: int = 100) -> DataFrame:
    """Concepts that occur in at least ``min_persons`` persons over all the event tables.

    Tasks hold the distinct pairs of person and concept of what they read, so that is kept small; the counts are stored.
    """
    pairs = union_all([t.where(F.col(c).isNotNull()).select("person_id", F.col(c).cast("long").alias("concept_id"))
                       for t, c in tables]).distinct()
    with pieces(pairs.sparkSession):
        return stable(pairs.groupBy("concept_id").agg(F.count("*").alias("n_persons")).where(F.col("n_persons") >= min_persons))


# ------------------------------------------------------------------ building


def build_sequences(person: DataFrame, visits: DataFrame, events: DataFrame, max_tokens: int | None = None) -> DataFrame:
    """One row per person: tokens in time order with parallel value arrays.

    ``events`` has person_id, visit_occurrence_id, concept_id, number_value, concept_value. Tokens:
    year and age at the first visit and the gender concept; per visit a gap token with the days since
    the start of the visit before, the start marker, the visit type, the concepts, the end marker.
    The array of a person is one output value; everything before it is plain rows. With
    ``max_tokens`` longer sequences, which the cleaning step leaves out, are found by counting and
    never collected.
    """
    born = person.select("person_id", "year_of_birth", "gender_concept_id")
    order = Window.partitionBy("person_id").orderBy("visit_start_date", "visit_occurrence_id")
    stays = visits.where(F.col("visit_start_date").isNotNull()).select(
        "person_id", "visit_occurrence_id", "visit_concept_id", F.col("visit_start_date").cast("date").alias("visit_start_date"))
    ranked = stays.withColumn("before", F.lag("visit_start_date").over(order))
    no_num, no_text = F.lit(None).cast("double"), F.lit(None).cast("string")

    def rows(df, date, visit, part, token, number=no_num, text=no_text, sort=F.lit("")):
        return df.select("person_id", date.alias("day"), visit.alias("visit"), F.lit(part).alias("part"), sort.alias("sort"),
                         token.alias("token"), number.alias("number"), text.alias("text"))

    start, vid = F.col("visit_start_date"), F.col("visit_occurrence_id").cast("long")
    first = stays.groupBy("person_id").agg(F.min("visit_start_date").alias("first")).join(born, "person_id")
    f, none = F.col("first"), F.lit(-1).cast("long")
    parts = [
        rows(first, f, none, 0, F.concat(F.lit("year:"), F.year(f).cast("string"))),
        rows(first.where(F.col("year_of_birth").isNotNull()), f, none, 1,
             F.concat(F.lit("age:"), (F.year(f) - F.col("year_of_birth")).cast("string"))),
        rows(first, f, none, 2, F.col("gender_concept_id").cast("string")),
        rows(ranked.where(F.col("before").isNotNull()), start, vid, 3,
             F.concat(F.lit("i-D"), F.datediff("visit_start_date", "before").cast("string"))),
        rows(ranked, start, vid, 4, F.lit(VISIT_START)),
        rows(ranked, start, vid, 5, F.col("visit_concept_id").cast("string")),
        rows(ranked, start, vid, 7, F.lit(VISIT_END)),
        rows(events.join(stays.select("person_id", "visit_occurrence_id", "visit_start_date"), ["person_id", "visit_occurrence_id"]),
             start, vid, 6, F.col("concept_id").cast("string"), F.col("number_value").cast("double"), F.col("concept_value"),
             F.lpad(F.col("concept_id").cast("string"), 20, "0")),
    ]
    tokens = union_all(parts).join(born.select("person_id", "year_of_birth"), "person_id", "left")
    if max_tokens is not None:
        short = tokens.groupBy("person_id").agg(F.count("*").alias("n")).where(F.col("n") <= max_tokens)
        tokens = tokens.join(short, "person_id", "left_semi")
    item = F.struct("day", "visit", "part", "sort", "number", "text", "token", "year_of_birth")
    seq = tokens.groupBy("person_id").agg(F.sort_array(F.collect_list(item)).alias("s"))
    has_value = lambda x: (x["number"].isNotNull() | x["text"].isNotNull()).cast("int")
    return seq.select(
        "person_id",
        F.transform("s", lambda x: x["token"]).alias("concept_ids"),
        F.transform("s", has_value).alias("concept_value_masks"),
        F.transform("s", lambda x: x["number"]).alias("number_as_values"),
        F.transform("s", lambda x: x["text"]).alias("concept_as_values"),
        F.transform("s", lambda x: F.year(x["day"]) - x["year_of_birth"]).alias("ages"),
        F.transform("s", lambda x: F.floor(F.datediff(x["day"], F.lit("1970-01-01").cast("date")) / 7).cast("int")).alias("dates"),
        F.transform("s", lambda x: (F.datediff(x["day"], F.lit("1970-01-01").cast("date")) * 86400).cast("double")).alias("epoch_times"),
        F.size("s").alias("num_of_concepts"))


def clean_sequences(seqs: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """Nulls inside the numeric arrays become 0; sequences longer than the limit are left out."""
    def filled(c, zero):
        return F.transform(c, lambda x: F.coalesce(x, F.lit(zero))).alias(c)
    fills = {"ages": 0, "dates": 0, "epoch_times": 0.0}
    return seqs.where(F.col("num_of_concepts") <= max_tokens).select(*[
        filled(c, fills[c]) if c in fills else F.col(c) for c in seqs.columns])


def kept_share(seqs: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    return seqs.agg(F.count("*").alias("n_sequences"), F.count_if(F.col("num_of_concepts") <= max_tokens).alias("n_kept")).withColumn(
        "kept_pct", ratio(100 * F.col("n_kept"), F.col("n_sequences")))


def gap_days(token: Column) -> Column:
    """Days of a gap token: ``i-D6`` is 6; otherwise a trailing signed number, not below 0; else 0."""
    second = F.get(F.split(token, "-"), F.lit(1))
    tail = F.regexp_extract(token, r"(-?\d+)$", 1).try_cast("int")
    usable = F.size(F.split(token, "-")) >= 2
    return F.coalesce(F.when(usable, F.substr(second, F.lit(2)).try_cast("int")), F.greatest(tail, F.lit(0)), F.lit(0))


def safe_int(value: Column) -> Column:
    """Integer cast where null and NaN become 0."""
    return F.coalesce(F.nanvl(value.cast("double"), F.lit(0.0)), F.lit(0.0)).cast("long")


def parse_token_text(text: Column) -> Column:
    """Array from its printed form ``['a' 'b']``."""
    bare = F.regexp_replace(F.regexp_replace(text, r"^\[|\]$", ""), "'", "")
    return F.filter(F.split(bare, r"\s+"), lambda x: x != "")


# ------------------------------------------------------------------ reading back


#: Positions of a sequence that are read together.
CHUNK = 4096


def sequence_events(seqs: DataFrame, concept: DataFrame) -> DataFrame:
    """Token arrays back to dated events with the domain of each concept.

    The first day is January 1 of the year token (null if it has no year of four digits); gap tokens move it forward. Sequences are
    read in chunks of ``CHUNK`` positions: what the chunks before it add up to is carried into each, so no window holds more
    tokens than a chunk, however long a sequence is.
    """
    rows = seqs.select("person_id", F.posexplode(F.arrays_zip("concept_ids", "number_as_values", "concept_as_values")).alias("pos", "t")).select(
        "person_id", "pos", F.col("t.concept_ids").alias("token"), F.col("t.number_as_values").alias("value_as_number"),
        F.col("t.concept_as_values").alias("value_as_concept"))
    is_gap = F.col("token").startswith("i-")
    marked = rows.withColumns({
        "__chunk": F.floor(F.col("pos") / CHUNK), "__days": F.when(is_gap, gap_days(F.col("token"))).otherwise(0).cast("long"),
        "__start": (F.col("token") == VISIT_START).cast("long"), "__year": F.when(F.col("token").rlike("^year:[0-9]{4}$"), F.substr("token", F.lit(6)).cast("int"))})
    before = Window.partitionBy("person_id").orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = (marked.groupBy("person_id", "__chunk").agg(F.sum("__days").alias("d"), F.sum("__start").alias("s"), F.max("__year").alias("y"))
               .select("person_id", "__chunk", F.coalesce(F.sum("d").over(before), F.lit(0)).alias("__d"), F.coalesce(F.sum("s").over(before), F.lit(0)).alias("__s"),
                       F.max("y").over(Window.partitionBy("person_id")).alias("year")))
    inside = Window.partitionBy("person_id", "__chunk").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    dated = (marked.withColumns({"__in_d": F.sum("__days").over(inside), "__in_s": F.sum("__start").over(inside)}).join(carried, ["person_id", "__chunk"])
             .withColumns({"offset": F.col("__d") + F.col("__in_d"), "visit_no": F.col("__s") + F.col("__in_s")}))
    ids = dated.where(F.col("token").rlike(r"^\d+$") & (F.col("visit_no") > 0)).withColumn("concept_id", F.col("token").try_cast("long"))
    domains = concept.groupBy(F.col("concept_id").cast("long").alias("concept_id")).agg(F.min("domain_id").alias("domain_id"))
    return ids.join(domains, "concept_id").select(
        "person_id", "pos", "visit_no", "concept_id", "domain_id",
        F.date_add(F.make_date("year", F.lit(1), F.lit(1)), F.col("offset").cast("int")).alias("event_date"),
        "value_as_number", "value_as_concept")


def route_by_domain(events: DataFrame, routes: Mapping[str, str]) -> dict[str, DataFrame]:
    """One event table per name in ``routes`` (table name -> domain)."""
    return {table: events.where(F.col("domain_id") == domain).drop("domain_id") for table, domain in routes.items()}


def write_routed(events: DataFrame, routes: Mapping[str, str], path: str) -> None:
    """Write the events of each table of ``routes`` (table name -> domain) into its own folder, in one pass over the events."""
    table = F.coalesce(*[F.when(F.col("domain_id") == domain, name) for name, domain in routes.items()])
    events.withColumn("table_name", table).where(F.col("table_name").isNotNull()).drop("domain_id").write.partitionBy("table_name").mode("overwrite").parquet(path)


# ------------------------------------------------------------------ audits


def token_shares(seqs: DataFrame, concept: DataFrame) -> DataFrame:
    """Share of markers, year, age and numeric tokens, and of numeric tokens known to the vocabulary."""
    tokens = seqs.select(F.explode("concept_ids").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    known = concept.select(F.col("concept_id").cast("string").alias("token")).distinct().withColumn("known", F.lit(1))
    x = tokens.join(known, "token", "left")
    numeric = F.col("token").rlike(r"^\d+$")

    def share(cond):
        return ratio(F.sum(F.when(cond, F.col("n")).otherwise(0)), F.sum("n"))

    return x.agg(
        share(F.col("token") == VISIT_START).alias("visit_start_share"), share(F.col("token") == VISIT_END).alias("visit_end_share"),
        share(F.col("token").startswith("year:")).alias("year_share"), share(F.col("token").startswith("age:")).alias("age_share"),
        share(numeric).alias("numeric_share"),
        ratio(F.sum(F.when(numeric & F.col("known").isNotNull(), F.col("n")).otherwise(0)),
              F.sum(F.when(numeric, F.col("n")).otherwise(0))).alias("known_share"))


def unknown_tokens(seqs: DataFrame, concept: DataFrame, k: int = 25) -> DataFrame:
    """The most frequent numeric tokens that are not in the vocabulary."""
    tokens = seqs.select(F.explode("concept_ids").alias("token")).where(F.col("token").rlike(r"^\d+$")).groupBy("token").agg(
        F.count("*").alias("n"))
    known = concept.select(F.col("concept_id").cast("string").alias("token")).distinct()
    return tokens.join(known, "token", "left_anti").orderBy(F.desc("n"), "token").limit(k)


def sequence_lengths(seqs: DataFrame) -> DataFrame:
    """Distribution of the number of tokens per sequence."""
    rows = seqs.select(F.lit("tokens").alias("measure"), F.size("concept_ids").alias("len"))
    return exact_quantiles(rows, ["measure"], "len", {"p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99})


def value_audit(seqs: DataFrame) -> DataFrame:
    """Persons with numeric values, categorical values and a death concept; number of numeric values."""
    numbers = F.size(F.filter("number_as_values", lambda x: x.isNotNull() & (x != 0)))
    masked = F.aggregate("concept_value_masks", F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) > 0
    texts = F.exists("concept_as_values", lambda x: x.isNotNull() & (x != ""))
    dead = F.exists("concept_ids", lambda x: x.isin(*DEATH_CONCEPTS))
    n = F.count("*")
    return seqs.agg(
        n.alias("n_sequences"), F.count_if(masked).alias("with_values"), F.sum(numbers).alias("total_values"),
        F.count_if(texts).alias("with_categories"), F.count_if(dead).alias("with_death")).withColumn(
        "with_values_pct", ratio(100 * F.col("with_values"), F.col("n_sequences")))


# ------------------------------------------------------------------ shifting dates


def person_shifts(person: DataFrame, visits: DataFrame, seed: int = 7) -> DataFrame:
    """Days to move each person's events, so that the first visit falls on a random day of its year,
    not before the birth year."""
    first = visits.groupBy("person_id").agg(F.min(F.col("visit_start_date").cast("date")).alias("f"))
    born = person.groupBy("person_id").agg(F.min("year_of_birth").alias("yob"))
    x = first.where(F.col("f").isNotNull()).join(born, "person_id", "left")
    year = F.year("f")
    lo = F.make_date(F.greatest(year, F.coalesce("yob", year)), F.lit(1), F.lit(1))
    span = F.greatest(F.datediff(F.make_date(year, F.lit(12), F.lit(31)), lo), F.lit(0))
    to = F.date_add(lo, F.floor(hash_uniform(seed, "person_id") * (span + 1)).cast("int"))
    return x.select("person_id", F.datediff(to, F.col("f")).alias("shift_days"))


def shift_events(tables: Mapping[str, DataFrame], shifts: DataFrame) -> dict[str, DataFrame]:
    """Move every date column of every table by the person's shift; persons without visits stay."""
    out = {}
    for name, t in tables.items():
        kinds = {f.name: f.dataType.typeName() for f in t.schema.fields}
        dates = [c for c in t.columns if "date" in c.lower() and kinds[c].startswith(("date", "timestamp"))]
        days = F.coalesce(F.col("shift_days"), F.lit(0))
        moved = {c: F.date_add(F.col(c), days) if kinds[c] == "date" else F.col(c) + F.make_dt_interval(days) for c in dates}
        out[name] = t.join(shifts, "person_id", "left").withColumns(moved).drop("shift_days") if dates else t
    return out


def random_birthdays(person: DataFrame, seed: int = 7) -> DataFrame:
    """A random valid month and day of birth; the year is kept."""
    month = (F.floor(hash_uniform(f"{seed}m", "person_id") * 12) + 1).cast("int")
    x = person.withColumn("month_of_birth", month)
    days = F.dayofmonth(F.last_day(F.make_date("year_of_birth", "month_of_birth", F.lit(1))))
    day = (F.floor(hash_uniform(f"{seed}d", "person_id") * days) + 1).cast("int")
    return x.withColumn("day_of_birth", day).withColumn("birth_date", F.make_date("year_of_birth", "month_of_birth", "day_of_birth"))
