"""Personal data by patterns, and the words that give it away by what the corpus says of them.

Patterns find e-mail addresses, IP addresses, card and phone numbers: the protected entities. Words
near them are counted with them over all documents. A word discloses an entity if knowing the word
leaves almost nothing unknown of the entity: the pointwise mutual information of both comes near the
information content of the entity. Such words are marked wherever they stand, also in documents that
hold no pattern, and replaced by their prefix class if that class discloses nothing, else removed.

Everything is DataFrame functions. Texts are read in three passes and only those with a disclosing
word move. Matches are placed by the lengths of what stands between them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triloom.llm.common import Scratch, ascii_lower, likely, row_keys

_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
#: What may be an entity of each kind, in the order of results. Repetitions are possessive and begin at
#: the start of a run, which finds the same leftmost matches in one pass; a card has 13 to 19 digits.
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold to be looked at for a kind, where a search for it is cheaper.
NEEDS = {"email": "@", "phone": "+"}
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
TERM = "term"
#: A term is a run of letters, digits and characters beyond ASCII with A-Z lower-cased, that is no number.
GAPS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SHORTEST, LONGEST_TERM, PREFIX = 3, 64, 3
#: Terms looked at on each side of an entity, and within how many characters.
NEAR, REACH = 5, 128
#: A term discloses an entity if they stand together in SUPPORT documents, share LEAST_BITS of
#: information, and RESIDUE bits of the entity's are left at most (a probability of 0.79).
SUPPORT, LEAST_BITS, RESIDUE = 3, 3.0, 1 / 3


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is evaluated once."""
    return F.transform(F.array(value), body)[0]


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    turned = F.reverse(number)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(turned, i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(1), F.char_length(number)), F.lit(0), add) % 10 == 0


VALID: dict[str, Callable[[Column], Column]] = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: m.rlike(rf"^{_BYTE}\.{_BYTE}\.{_BYTE}\.{_BYTE}$"),
    "card": lambda m: luhn(digits(m)),
    "phone": lambda m: F.char_length(digits(m)).between(9, 15),
}
VALUE: dict[str, Callable[[Column], Column]] = {"email": ascii_lower, "ip": lambda m: m, "card": digits, "phone": digits}


def is_term(word: Column) -> Column:
    return F.char_length(word).between(SHORTEST, LONGEST_TERM) & word.rlike("[^0-9]")


def _near(piece: Column, left: bool) -> Column:
    """The terms of a piece next to an entity; a word that is cut by REACH is none."""
    size = F.char_length(piece)
    part = F.substring(piece, F.greatest(size - REACH + 1, F.lit(1)), F.lit(REACH)) if left else F.substring(piece, 1, REACH)
    words = let(F.split(ascii_lower(part), GAPS), lambda w: F.when(size <= REACH, w).otherwise(F.slice(w, 2 if left else 1, F.size(w) - 1)))
    terms = F.filter(words, is_term)
    return let(terms, lambda t: F.slice(t, F.greatest(F.size(t) - NEAR + 1, F.lit(1)), F.lit(NEAR))) if left else F.slice(terms, 1, NEAR)


def matches(text: Column, pattern: Column) -> Column:
    """(found, start, end, before, after) of every match, in order.

    A split gives what stands between matches, so a start is a sum of lengths. Sums go by blocks of
    about the root of the number of matches n, which takes n to the power 1.5 steps, with no quadratic array.
    """

    def placed(s: Column) -> Column:
        n = F.size(s["found"])
        width = F.ceil(F.sqrt(n)).cast("int")
        sizes = F.zip_with(s["found"], F.slice(s["gaps"], F.lit(1), n), lambda m, gap: F.char_length(m) + F.char_length(gap))

        def sums(first: Column, count: Column, of: Column) -> Column:
            return F.aggregate(F.slice(of, first, count), F.lit(0), lambda a, x: a + x)

        def one(t: Column) -> Column:
            def each(found: Column, i: Column) -> Column:
                block = F.floor(i / t["width"]).cast("int")
                before, after = F.get(s["gaps"], i), F.get(s["gaps"], i + 1)
                start = F.get(t["heads"], block) + sums(block * t["width"] + 1, i % t["width"], t["sizes"]) + F.char_length(before)
                return let(start, lambda at: F.struct(found.alias("found"), at.alias("start"), (at + F.char_length(found)).alias("end"), before.alias("before"), after.alias("after")))

            return F.transform(s["found"], each)

        heads = lambda sizes: F.transform(F.sequence(F.lit(0), F.floor((n - 1) / width).cast("int")), lambda b: sums(F.lit(1), b * width, sizes))
        held = let(sizes, lambda z: F.struct(z.alias("sizes"), heads(z).alias("heads"), width.alias("width")))
        return F.when(n == 0, F.array().cast("array<struct<found:string,start:int,end:int,before:string,after:string>>")).otherwise(let(held, one))

    return let(F.struct(F.regexp_extract_all(text, pattern, F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("gaps")), placed)


ENTITY = "array<struct<kind:string,start:int,end:int,value:string,near:array<string>>>"


def entities(text: Column) -> Column:
    """(kind, start, end, value, near) of all base entities, by kind and then start."""

    def of(kind: str) -> Column:
        pattern = F.lit(PATTERNS[kind])
        valid = F.filter(matches(text, pattern), lambda m: VALID[kind](m["found"]))
        found = F.transform(
            valid,
            lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), VALUE[kind](m["found"]).alias("value"), F.array_distinct(F.concat(_near(m["before"], True), _near(m["after"], False))).alias("near")),
        )
        asked = F.contains(text, F.lit(NEEDS[kind])) if kind in NEEDS else text.rlike(PATTERNS[kind])
        return F.when(asked, found.cast(ENTITY)).otherwise(F.array().cast(ENTITY))

    return F.concat(*[of(k) for k in PATTERNS])


def _prefix(word: Column) -> Column:
    return F.concat(F.substring(word, 1, PREFIX), F.lit("*"))


def _documents_with(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(term, documents) of the wanted terms and prefix classes (ending in *), over whole texts."""
    words = F.array_distinct(F.split(ascii_lower(F.col("text")), GAPS))
    classes = let(F.col("w"), lambda w: F.array_distinct(F.transform(F.filter(w, lambda x: (F.char_length(x) > PREFIX) & is_term(x)), _prefix)))
    rows = texts.select(words.alias("w")).select(F.explode(F.concat("w", classes)).alias("term")).where(F.char_length("term") >= SHORTEST)
    counted = likely(rows, wanted, "term").groupBy("term").agg(F.count("*").alias("documents"))
    return counted.join(wanted, "term", "left_semi")


def disclosures(texts: DataFrame, base: DataFrame, scratch: Scratch, support: int = SUPPORT, least_bits: float = LEAST_BITS, residue: float = RESIDUE) -> DataFrame:
    """(term, replacement, bits) of the terms that disclose an entity; replacement is their prefix class,
    or empty if that discloses one too, and bits the largest information shared with an entity.

    With N documents, of which d hold the entity, t the term and f both near each other, the term's
    information on it is log2(N f / (d t)), the entity's own log2(N / d), and log2(t / f) is left.
    """
    number = base.count()
    named = F.transform("entities", lambda e: F.concat(e["kind"], F.lit(":"), e["value"]))
    with_entity = base.where(F.size("entities") > 0)
    of_entity = with_entity.select(F.explode(F.array_distinct(named)).alias("entity")).groupBy("entity").agg(F.count("*").alias("d"))
    # Entities, terms and classes hold no tab.
    both = F.flatten(F.transform("entities", lambda e: F.transform(F.concat(e["near"], F.transform(F.filter(e["near"], lambda t: F.char_length(t) > PREFIX), _prefix)), lambda t: F.concat(e["kind"], F.lit(":"), e["value"], F.lit("\t"), t))))
    pairs = with_entity.select(F.explode(F.array_distinct(both)).alias("pair")).groupBy("pair").agg(F.count("*").alias("f")).where(F.col("f") >= support)
    pairs = pairs.select(F.split("pair", "\t")[0].alias("entity"), F.split("pair", "\t")[1].alias("term"), "f").join(of_entity, "entity")
    pairs = scratch.cut(pairs, "together")
    documents = scratch.cut(_documents_with(texts, pairs.select("term").distinct()), "documents")
    f, d, t = (F.col(c).cast("double") for c in ("f", "d", "documents"))
    n = F.lit(float(number))
    known = pairs.join(documents, "term").where((n * f >= 2.0**least_bits * d * t) & (f >= 2.0**-residue * t))
    known = scratch.cut(known.groupBy("term").agg(F.max(F.log2(n * f / (d * t))).alias("bits")), "disclosing")
    told = known.where(F.col("term").endswith("*")).select(F.col("term").alias("class"), F.lit(True).alias("told"))
    terms = known.where(~F.col("term").endswith("*")).withColumn("class", F.when(F.char_length("term") > PREFIX, _prefix(F.col("term"))))
    return terms.join(told, "class", "left").select("term", F.when(F.col("told").isNull(), F.coalesce("class", F.lit(""))).otherwise("").alias("replacement"), "bits")


TERM_SPANS = "array<struct<kind:string,start:int,end:int,replacement:string>>"


def _found(docs: DataFrame, scratch: Scratch, ident: str, text: str, **thresholds) -> tuple[DataFrame, DataFrame]:
    """(key, text) and (key, doc_id, entities, terms) of every row, with a key that no two rows share."""
    rows = docs.select(F.col(ident).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows, key = row_keys(scratch, rows) or (rows, "doc_id")
    rows = rows.select(F.col(key).alias("key"), "doc_id", "text")
    base = scratch.cut(rows.select("key", "doc_id", entities(F.col("text")).alias("entities")), "base")
    told = scratch.cut(disclosures(rows, base, scratch, **thresholds), "told")
    words = rows.select("key", F.explode(F.array_distinct(F.split(ascii_lower(F.col("text")), GAPS))).alias("term")).where(F.char_length("term") >= SHORTEST)
    held = likely(words, told.select("term"), "term").join(told, "term")
    held = scratch.cut(held.groupBy("key").agg(F.collect_list(F.struct("term", "replacement")).alias("held")), "held")  # words of one text
    marked = likely(rows.select("key", "text"), held.select("key"), "key").join(held, "key")
    inside = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
    pattern = F.concat(F.lit(f"(?<!{inside})(?:"), F.array_join("held.term", "|"), F.lit(f")(?!{inside})"))
    replaced = F.map_from_entries("held")
    spans = F.transform(matches(ascii_lower(F.col("text")), pattern), lambda m: F.struct(F.lit(TERM).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), F.element_at(replaced, m["found"]).alias("replacement")))
    spans = scratch.cut(marked.select("key", spans.cast(TERM_SPANS).alias("terms")), "terms")
    apart = F.filter("terms", lambda t: ~F.exists("entities", lambda e: (e["start"] < t["end"]) & (t["start"] < e["end"])))
    both = base.join(spans, "key", "left").select("key", "doc_id", "entities", F.coalesce(apart, F.array().cast(TERM_SPANS)).alias("terms"))
    return rows.select("key", "text"), both


def find(
    docs: DataFrame, scratch: Scratch | None = None, ident: str = "doc_id", text: str = "text", support: int = SUPPORT, least_bits: float = LEAST_BITS, residue: float = RESIDUE
) -> DataFrame:
    """(doc_id, entities, terms) of every row: what patterns find, with the terms near it, and the
    disclosing terms outside of it as (kind, start, end, replacement). Places count code points.

    Null text counts as empty; rows that repeat an id or have none are documents each, and copies count
    as often as they occur. An empty table gives no rows; other columns are ignored.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    return _found(docs, scratch, ident, text, support=support, least_bits=least_bits, residue=residue)[1].drop("key")


def sanitised(
    docs: DataFrame, scratch: Scratch | None = None, ident: str = "doc_id", text: str = "text", support: int = SUPPORT, least_bits: float = LEAST_BITS, residue: float = RESIDUE
) -> DataFrame:
    """(doc_id, text, replaced) of every row: entities become [kind], disclosing terms their class, or
    [term] where that discloses an entity too; spans that overlap are replaced once, by the first's."""
    scratch = scratch or Scratch(docs.sparkSession)
    rows, both = _found(docs, scratch, ident, text, support=support, least_bits=least_bits, residue=residue)
    shown = F.transform("entities", lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"), F.concat(F.lit("["), e["kind"], F.lit("]")).alias("shown")))
    shown = F.concat(shown, F.transform("terms", lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), F.when(t["replacement"] == "", F.lit("[term]")).otherwise(t["replacement"]).alias("shown"))))

    def put(done: Column, s: Column) -> Column:
        gap = F.substring(F.col("text"), done["at"] + 1, F.greatest(s["start"] - done["at"], F.lit(0)))
        inside = s["start"] < done["at"]
        return F.struct(F.concat(done["out"], gap, F.when(inside, "").otherwise(s["shown"])).alias("out"), F.greatest(done["at"], s["end"]).alias("at"))

    rest = lambda d: F.concat(d["out"], F.substring(F.col("text"), d["at"] + 1, F.char_length(F.col("text"))))
    new = F.aggregate("shown", F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), put, rest)
    spans = both.select("key", "doc_id", F.array_sort(shown).alias("shown"))
    return rows.join(spans, "key").select("doc_id", new.alias("text"), F.size("shown").alias("replaced"))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def personal_data(docs: DataFrame, scratch: Scratch | None = None, **named) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, n_term, base_sha256, spans of every row, as `find` says.

    base_sha256 digests the entities as kind:start:end, by kind and start, comma-joined; spans lists them,
    and behind them the terms of the method.
    """
    found = find(docs, scratch, **named)
    kinds = F.transform("entities", lambda e: e["kind"])
    counts = [(F.size("entities") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in PATTERNS]
    listed = found.select("doc_id", *counts, F.size("terms").cast("long").alias("n_term"), _listed(F.col("entities")).alias("base"), _listed(F.col("terms")).alias("more"))
    spans = F.array_join(F.filter(F.array("base", "more"), lambda s: s != ""), ",")
    return listed.select("doc_id", *[f"n_{k}" for k in PATTERNS], "n_term", F.sha2("base", 256).alias("base_sha256"), spans.alias("spans"))
