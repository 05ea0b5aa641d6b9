"""Surrogates for personal data: keyed, of the same type and format, distinct, and the same wherever the entity stands."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

# Forms of address by gender and the patterns of the entity types, in order of precedence.
MALE = ("Mr", "Sir", "Herr", "Señor", "Sr", "Monsieur", "Signor", "Господин", "г-н", "Κύριος")
FEMALE = ("Mrs", "Ms", "Miss", "Madam", "Frau", "Señora", "Sra", "Madame", "Mme", "Signora", "Госпожа", "г-жа", "Κυρία")
NEUTRAL = ("Dr", "Prof")
TITLES = "|".join((*MALE, *FEMALE, *NEUTRAL))
_NAME = r"\p{Lu}[\p{L}'’-]+"
# Small words inside a name, which stay as they are.
_PARTICLES = r"(?:(?:van|von|der|den|de|del|della|di|da|do|dos|das|du|la|le|zu|zur|bin|ibn|al|el|ter|ten|af|av|y|e) )*"
PATTERNS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
    ("ip", r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\.?[0-9])"),
    ("phone", r"(?<![0-9+])(?:\+?[0-9]{1,3}[ .-]?)?\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])|(?<![0-9+.-])(?:\+[0-9]{1,3}[ .-])?[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])"),
    ("card", r"(?<![0-9])[0-9]{4}(?:[ -]?[0-9]{4}){3}(?![0-9])"),
    ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    ("name", rf"(?<![\p{{L}}])(?:{TITLES})\.? {_PARTICLES}{_NAME}(?: {_PARTICLES}{_NAME})*"),
)
ANY = "(" + "|".join(p for _, p in PATTERNS) + ")"
# Syllables of made-up names by script, and endings by gender.
SYLLABLES = {"latin": "ba be bo da de do fa fe ga ge ka ke la le li lo ma me mi mo na ne no pa pe ra re ri ro sa se ta te to va ve".split(),
             "cyrillic": "ба бе бо ва ве га го да де до за зо ка ко ла ле ло ма ме мо на не но па по ра ре ро са се со та те то".split(),
             "greek": "βα βε γα γο δα δε κα κο λα λε λο μα με μο να νε νο πα πε ρα ρε ρο σα σε τα τε το".split()}
ENDINGS = {"latin": {"given_m": "rus", "given_f": "lina", "given_u": "ren", "family": "mer"},
           "cyrillic": {"given_m": "рий", "given_f": "лина", "given_u": "нин", "family": "мер"},
           "greek": {"given_m": "ρος", "given_f": "λινα", "given_u": "νι", "family": "μης"}}


def _at(digest: Column, i: Column, n: int) -> Column:
    """A number below n from the i-th of 32 four-digit groups of a hex digest of 128 digits."""
    return F.conv(F.substr(digest, (F.pmod(i, F.lit(32)) * 4 + 1).cast("int"), F.lit(4)), 16, 10).cast("int") % n


def hits(text: Column, pattern: Column | None = None) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(ANY) if pattern is None else pattern, F.lit(1))


def names_in(found: Column) -> Column:
    """The name words of the hits of one text: an array of kind, core and raw."""
    titled = F.filter(found, lambda h: h.rlike(rf"^(?:{TITLES})\.? "))
    return F.array_distinct(F.transform(F.flatten(F.transform(titled, lambda h: parts_of(h))), lambda x: F.struct(x["kind"].alias("kind"), x["core"].alias("core"), x["raw"].alias("raw"))))


def pattern_with(names: Column) -> Column:
    """The pattern of all entities and of the given names where they stand alone; names hold letters, ' and - only."""
    raw = F.transform(names, lambda x: x["raw"])
    forms = F.array_distinct(F.concat(raw, F.transform(raw, lambda r: F.initcap(r)), F.transform(raw, lambda r: F.upper(r))))
    longest_first = F.array_join(F.reverse(F.array_sort(forms)), "|")
    return F.when(F.size(names) > 0, F.concat(F.lit(ANY[:-1] + r"|(?<![\p{L}])(?:"), longest_first, F.lit(r")(?![\p{L}]))"))).otherwise(F.lit(ANY))


def parts_of(hit: Column, known: Column | None = None) -> Column:
    """The parts of a hit that stand for an entity: kind, core (what makes it the same entity), before and raw.

    ``known``: the names of the same text; a hit without a title is one of them.
    """

    def part(kind: Column, core: Column, before: Column, raw: Column) -> Column:
        return F.struct(kind.alias("kind"), core.alias("core"), before.alias("before"), raw.alias("raw"))

    title = F.regexp_extract(hit, rf"^({TITLES})\.? ", 0)
    bare = F.regexp_replace(title, r"\.? $", "")
    given = F.when(bare.isin(*MALE), F.lit("given_m")).when(bare.isin(*FEMALE), F.lit("given_f")).otherwise(F.lit("given_u"))
    rest = F.substr(hit, F.length(title) + 1)
    pattern = F.lit(rf"((?:^| ){_PARTICLES})({_NAME})")
    words, befores = F.regexp_extract_all(rest, pattern, F.lit(2)), F.regexp_extract_all(rest, pattern, F.lit(1))
    named = F.transform(words, lambda w, i: part(F.when(i == F.size(words) - 1, F.lit("family")).otherwise(given), F.lower(w),
                                                 F.concat(F.when(i == 0, title).otherwise(F.lit("")), F.element_at(befores, i + 1)), w))
    if known is not None:
        same = F.element_at(F.filter(known, lambda x: x["core"] == F.lower(hit)), 1)
        named = F.when(title == "", F.array(part(same["kind"], F.lower(hit), F.lit(""), hit))).otherwise(named)
    kind = F.coalesce(*[F.when(hit.rlike(f"^(?:{p})$"), F.lit(k)) for k, p in PATTERNS if k != "name"])
    plain = F.when(kind.isin("phone", "card", "ssn"), F.regexp_replace(hit, "[^0-9]", "")).when(kind == "iban", F.regexp_replace(hit, " ", "")).otherwise(F.lower(hit))
    return F.when(kind.isNull(), named).otherwise(F.array(part(kind, plain, F.lit(""), hit)))


def draw(key: str, kind: Column, core: Column, turn: Column) -> Column:
    """The surrogate core of an entity at its ``turn``-th draw; the same key, entity and turn always give the same. Names get a syllable more with every four turns."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), kind, core, turn.cast("string")), 512)
    chars = F.split(core, "")
    digit = lambda i, n=10: _at(digest, i, n).cast("string")
    letter = lambda i, first: F.char(_at(digest, i, 26) + ord(first))
    same_form = F.transform(chars, lambda c, i: F.when(c.rlike("[0-9]"), digit(i)).when(c.rlike("[a-z]"), letter(i, "a")).when(c.rlike("[A-Z]"), letter(i, "A")).otherwise(c))
    tail = F.length(F.substring_index(core, ".", -1)) + 1  # the last label of a mail address and its dot
    mail = F.concat(F.array_join(F.slice(same_form, 1, F.greatest(F.length(core) - tail, F.lit(0))), ""), F.right(core, tail))
    octets = F.array_join(F.transform(F.split(core, r"\."), lambda o, i: F.when(F.length(o) == 1, digit(i)).when(F.length(o) == 2, (_at(digest, i, 90) + 10).cast("string"))
                                      .otherwise((_at(digest, i, 156) + 100).cast("string"))), ".")
    keep = F.when(kind == "phone", F.greatest(F.length(core) - 10, F.lit(0))).when(kind == "card", F.lit(1)).when(kind == "iban", F.lit(2)).otherwise(F.lit(0))
    numbers = F.concat(F.left(core, keep), F.array_join(F.slice(same_form, keep + 1, F.greatest(F.length(core), F.lit(1))), ""))

    def name(script: str) -> Column:
        sounds = F.array(*[F.lit(s) for s in SYLLABLES[script]])
        n = len(SYLLABLES[script])
        made = F.array_join(F.transform(F.sequence(F.lit(0), F.least(F.lit(2) + F.floor(turn / 4).cast("int"), F.lit(31))), lambda i: F.element_at(sounds, _at(digest, i, n) + 1)), "")
        ending = F.coalesce(*[F.when(kind == k, F.lit(e)) for k, e in ENDINGS[script].items()])
        return F.concat(made, ending)

    names = F.when(core.rlike(r"\p{IsCyrillic}"), name("cyrillic")).when(core.rlike(r"\p{IsGreek}"), name("greek")).otherwise(name("latin"))
    return F.when(kind == "email", mail).when(kind == "ip", octets).when(kind.isin("phone", "card", "ssn", "iban"), numbers).otherwise(names)


def assign(entities: DataFrame, key: str, most_turns: int = 24) -> DataFrame:
    """A surrogate for each distinct (kind, core): no two of a kind share one, and none is itself a core that stands in the texts.

    All entities draw; of those that drew the same, one keeps it, and the others, with those that hit a real core or a
    surrogate given before, draw again. Names, which grow with the turns, draw until all have one; any other entity without luck in ``most_turns``
    draws, whose form has no free value left, gets a tag with a digest.
    """
    left, given = entities, None
    real = entities.select("kind", F.col("core").alias("surrogate"))
    for turn in count():
        drawn = left.select("kind", "core", draw(key, F.col("kind"), F.col("core"), F.lit(turn)).alias("surrogate"))
        free = drawn.join(real if given is None else real.unionAll(given.select("kind", "surrogate")), ["kind", "surrogate"], "left_anti")
        won = stored(free.groupBy("kind", "surrogate").agg(F.min("core").alias("core")).select("kind", "core", "surrogate"))
        given = won if given is None else given.unionAll(won)
        left = stored(left.join(won.select("kind", "core"), ["kind", "core"], "left_anti"))
        if left.isEmpty():
            return given
        if turn == most_turns - 1:
            named = F.col("kind").isin(*ENDINGS["latin"])
            tag = F.concat(F.lit("["), "kind", F.lit("-"), F.left(F.sha2(F.concat_ws("|", F.lit(key), "kind", "core"), 256), F.lit(16)), F.lit("]"))
            given = given.unionAll(left.where(~named).select("kind", "core", tag.alias("surrogate")))
            left = stored(left.where(named))
            if left.isEmpty():
                return given


def _pour(raw: Column, surrogate: Column, kind: Column) -> Column:
    """The surrogate in the form of what it replaces: separators and capitals as there."""
    chars = F.split(raw, "")
    place = lambda i: F.length(F.regexp_replace(F.substr(raw, F.lit(1), i + 1), "[^0-9A-Za-z]", ""))
    numbers = F.array_join(F.transform(chars, lambda c, i: F.when(c.rlike("[0-9A-Za-z]"), F.substr(surrogate, place(i), F.lit(1))).otherwise(c)), "")
    mail = F.array_join(F.transform(chars, lambda c, i: F.when(c.rlike("[A-Z]"), F.upper(F.substr(surrogate, i + 1, F.lit(1)))).otherwise(F.substr(surrogate, i + 1, F.lit(1)))), "")
    names = F.when((F.upper(raw) == raw) & (F.length(raw) > 1), F.upper(surrogate)).otherwise(F.initcap(surrogate))
    return (F.when(surrogate.startswith("["), surrogate).when(kind.isin("phone", "card", "ssn", "iban"), numbers).when(kind == "email", mail)
            .when(kind == "ip", surrogate).otherwise(names))


def replace_entities(documents: DataFrame, key: str, text: str = "text", salts: int = 16) -> DataFrame:
    """All columns, with the entities of ``text`` replaced, and ``n_entities``.

    A null text stays null and an empty one empty. The replacements of a text depend on the key and on the entities of all
    texts (through the collision checks), not on the order of rows. Texts without an entity are not shuffled; equal
    texts of one id are looked up once. The lookup of surrogates is salted, as one entity may stand in a third of all texts.
    Texts of any length are searched whole. Columns may have any names; one called ``n_entities`` gives way to the new one.
    """
    own = {c: f"c{i}" for i, c in enumerate(documents.columns)}
    out = _replaced(documents.toDF(*own.values()), key, own.get("doc_id", "c0"), own[text], salts)
    return out.select(*[F.col(n).alias(c) for c, n in own.items() if c != "n_entities"], "n_entities")


def _replaced(documents: DataFrame, key: str, id_: str, text: str, salts: int) -> DataFrame:
    tie = F.xxhash64(F.col(text))
    once = stored(documents.withColumn("_hits", hits(F.col(text))))  # the search costs more than one copy of the texts
    named = once.where("size(_hits) > 0").withColumn("_names", names_in(F.col("_hits")))
    # names are looked for again, without titles, in the texts that hold them
    rows = stored(named.withColumn("_hits", F.when(F.size("_names") > 0, hits(F.col(text), pattern_with(F.col("_names")))).otherwise(F.col("_hits"))))
    found = stored(rows.select(F.col(id_).alias("_id"), tie.alias("_tie"), F.col("_hits").alias("hits"), F.col("_names").alias("names")).dropDuplicates(["_id", "_tie"]))
    each = (found.select("_id", "_tie", "names", F.posexplode("hits").alias("at", "hit")).select("_id", "_tie", "at", F.posexplode(parts_of(F.col("hit"), F.col("names"))).alias("i", "p"))
            .select("_id", "_tie", "at", "i", "p.*"))
    surrogates = (assign(stored(each.select("kind", "core").distinct()), key)
                  .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))))
    made = (each.withColumn("salt", F.pmod("_tie", F.lit(salts)).cast("int")).join(surrogates, ["kind", "core", "salt"])
            .select("_id", "_tie", "at", "i", F.concat("before", _pour(F.col("raw"), F.col("surrogate"), F.col("kind"))).alias("now"))
            .groupBy("_id", "_tie").agg(F.array_sort(F.collect_list(F.struct("at", "i", "now"))).alias("now")))
    clean = once.where("size(_hits) = 0").drop("_hits").withColumn("n_entities", F.lit(0).cast("long"))
    gaps = F.split(F.col(text), pattern_with(F.col("_names")), -1)
    hit = lambda i: F.array_join(F.transform(F.filter("now", lambda x: x["at"] == i), lambda x: x["now"]), "")
    done = (rows.drop("_hits").join(made, F.col(id_).eqNullSafe(F.col("_id")) & (tie == F.col("_tie")))
            .withColumn("_text", F.array_join(F.transform(gaps, lambda g, i: F.concat(g, hit(i))), ""))
            .withColumn("n_entities", (F.size(gaps) - 1).cast("long")))
    changed = done.select(*[F.col("_text").alias(text) if c == text else F.col(c) for c in documents.columns], "n_entities")
    return clean.unionByName(changed)


def surrogate_table(documents: DataFrame, key: str = "surrogate key") -> DataFrame:
    """One row per document: doc_id, text with surrogates, number of entities."""
    return replace_entities(documents.select("doc_id", "text"), key)
