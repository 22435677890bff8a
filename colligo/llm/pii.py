"""Personal data in whole texts: four base kinds by pattern, and terms that disclose them; DataFrame functions only.

Base spans follow fixed patterns, leftmost and non-overlapping per kind; matches
that fail a kind's check are dropped. A protected entity is a kind with its
value. The corpus then says how strongly a term reveals an entity. It is counted
in contexts: lines, and of longer lines each stretch of CONTEXT tokens. With
n_te contexts that hold both, n_t the term, n_e the entity and n in all,

    disclosure = PMI(t; e) / IC(e) = ln(n_te * n / (n_t * n_e)) / ln(n / n_e)

which is 1 if the term never stands without the entity. For n_te / n_t stands
its lower confidence bound (Wilson's, at `z` standard errors) over the distinct
contexts, as copies of a line are no further evidence: a term that stands in one
context, with the entity, counts half, and entities in a single context have
disclosing terms as well. Terms are generalised from a disclosure of
`generalise` up and removed from `remove` up, wherever the corpus has them.

Terms are white-space tokens without a digit or @, stripped of what is not a
letter at both ends, lower-cased, of at least MIN_LETTERS characters.

Defined results: a null text is empty and has no spans; rows that repeat an id
and text have the same spans; rows without an id are handled like others; an
empty table gives an empty table; offsets count code points of the whole text;
extra columns are ignored by `find` and kept by `sanitise`. Very long texts,
lines and runs of digits, dots or signs are matched without recursion and in
nearly linear time, and a context makes no more pairs of terms and entities
than its tokens allow, however long its line.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colligo.llm.common import staged, text_or_empty

# The base patterns, in the order in which kinds are listed.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TERM = "term"
MIN_LETTERS = 3
#: Hash values by which terms of texts are held against disclosing ones before they are joined.
SLOTS = 1 << 22
#: White space and what is none, listed by characters, which the Java matcher looks up in one table. On negated classes with
#: ranges threads of one JVM slow each other down: six took about six times as long as one, each for as much text.
_SPACE, _DIGIT = r"\x20\x09\x0A\x0B\x0C\x0D", "0123456789"
_SOLID = f"[^{_SPACE}]"
TOKEN = f"{_SOLID}+"
#: The same matches as PATTERNS, in the form that the Java matcher works through without recursion: possessive groups, and
#: runs of digits or name characters entered only at their start (or, for addresses, right after a match).
_ITERATIVE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": PATTERNS["phone"],
}
#: Tokens of a context. It goes on over tokens that could be the rest of a number, so that no span is cut.
CONTEXT = 256
_GAP = r"[\x20\x09\x0B\x0C\x0D]"
_CONTEXT = rf"(?:{_SOLID}++{_GAP}*+){{1,{CONTEXT}}}+(?:[{_DIGIT}().-]{_SOLID}*+{_GAP}*+)*+"
#: A token; group 1 holds it from its first letter to its last, and nothing if it has a digit or @ or no letter.
_WORD = rf"[^{_SPACE}{_DIGIT}@]*+[{_DIGIT}@]{_SOLID}*+|{_SOLID}*?(\p{{L}}(?:{_SOLID}*\p{{L}})?){_SOLID}*+|{_SOLID}++"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is worked out once however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ends(lengths: Column) -> Column:
    """Running sums of an array of numbers, over sums of blocks of about the square root of its size."""

    def of(all_: Column, width: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / width).cast("int")), lambda b: F.slice(all_, b * width + 1, width))
        total = lambda xs: F.aggregate(xs, F.lit(0), lambda p, q: p + q)
        summed = lambda bs: F.transform(bs, total)
        inner = lambda bs, ts: F.flatten(F.transform(bs, lambda block, b: let(total(F.slice(ts, F.lit(1), b)), lambda base: F.transform(block, lambda _, i: base + total(F.slice(block, F.lit(1), i + 1))))))
        return let(blocks, lambda bs: let(summed(bs), lambda ts: inner(bs, ts)))

    none = F.array().cast("array<int>")
    return let(lengths, lambda x: F.when(F.size(x) > 0, let(F.ceil(F.sqrt(F.size(x))).cast("int"), lambda w: of(x, w))).otherwise(none))


def _valid(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    n = F.length(digits)
    if kind == "ip":
        part = lambda p: F.length(F.ltrim(p, F.lit("0"))).between(0, 3) & (F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0)) <= 255)
        return F.forall(F.split(m, r"\."), part)
    if kind == "card":
        # From the right, every second digit is doubled and its digits summed.
        digit = lambda i: F.substring(digits, n - i + F.lit(1), F.lit(1)).cast("int")
        luhn = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, i: acc + F.when(i % 2 == 1, digit(i)).when(digit(i) < 5, 2 * digit(i)).otherwise(2 * digit(i) - 9))
        return F.when(n.between(13, 19), luhn % 10 == 0).otherwise(False)
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def matches(text: Column, pattern: str, keep: Callable[[Column], Column], guard: Column | None = None) -> Column:
    """array<struct<start, end, value>> of the matches that keep(value) accepts; offsets in code points."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    if guard is not None:
        found = F.when(guard, found).otherwise(F.array().cast("array<string>"))
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")

    def placed(ms: Column) -> Column:
        lengths = F.zip_with(F.split(text, pattern, -1), ms, lambda s, m: F.length(s) + F.coalesce(F.length(m), F.lit(0)))
        at = lambda e: F.transform(ms, lambda m, i: F.struct((e[i] - F.length(m)).alias("start"), e[i].alias("end"), m.alias("value")))
        return let(ends(lengths), lambda e: F.filter(at(e), lambda x: keep(x["value"])))

    return let(found, lambda ms: F.when(F.exists(ms, keep), placed(ms)).otherwise(none))


def base_spans(text: Column) -> Column:
    """array<struct<kind, start, end, value>> in the order of kinds, then start."""

    def of(kind: str) -> Column:
        guard = F.contains(text, F.lit({"email": "@", "ip": ".", "phone": "+"}[kind])) if kind != "card" else None
        found = matches(text, _ITERATIVE[kind], lambda m: _valid(kind, m), guard)
        return F.transform(found, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value")))

    return F.concat(*map(of, KINDS))


def stripped(token: Column) -> Column:
    """A token without what is not a letter at its ends; empty if it has a digit or @."""
    return F.regexp_extract(token, _WORD, 1)


def is_term(token: Column) -> Column:
    return F.length(stripped(token)) >= MIN_LETTERS


def terms_of(text: Column) -> Column:
    """The distinct terms of a text or a part of one."""
    words = F.regexp_extract_all(text, F.lit(_WORD), F.lit(1))
    return F.array_distinct(F.transform(F.filter(words, lambda t: F.length(t) >= MIN_LETTERS), F.lower))


def contexts(text: Column) -> Column:
    """The lines of a text that are not blank, longer ones in stretches of CONTEXT tokens."""
    return F.regexp_extract_all(text, F.lit(_CONTEXT), F.lit(0))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def entities(found: DataFrame) -> DataFrame:
    """One row per context with base spans: c, a hash of it, its entities es (hashes of kind and value) and its terms."""
    lines = found.where("size(spans) > 0").select(F.explode(contexts(F.col("text"))).alias("line"))
    spans = lines.select("line", base_spans(F.col("line")).alias("spans")).where("size(spans) > 0")
    es = F.array_distinct(F.transform("spans", lambda s: F.md5(F.concat_ws(":", s["kind"], F.lower(s["value"])))))
    return spans.select(F.xxhash64("line").alias("c"), es.alias("es"), terms_of(F.col("line")).alias("terms"))


def disclosing_terms(rows: DataFrame, ents: DataFrame, z: float = 1.0, generalise: float = 0.75, remove: float = 0.95) -> DataFrame:
    """(term, e, disclosure, action) of terms over the thresholds; rows has the texts of the corpus."""
    seen = ents.select("c", "terms", F.explode("es").alias("e")).select("c", "e", F.explode("terms").alias("term"))
    pairs = seen.groupBy("term", "e").agg(F.count("*").alias("n_te"), F.countDistinct("c").alias("lines"))
    n_e = ents.select(F.explode("es").alias("e")).groupBy("e").agg(F.count("*").alias("n_e"))
    n_t = staged(context_counts(rows, slot_bits(seen.select("term").distinct())), "counts")
    n = n_t.where("term = ''").agg(F.sum("n_t")).first()[0] or 0
    counted = pairs.join(n_t, "term").join(n_e, "e")
    ic = F.log(F.lit(float(n)) / F.col("n_e"))
    # Trials are as many as distinct contexts make of the share.
    p = F.col("n_te").cast("double") / F.col("n_t")
    trials, zz = F.col("lines") / p, F.lit(z * z)
    bound = (p + zz / (2 * trials) - F.lit(z) * F.sqrt(p * (1 - p) / trials + zz / (4 * trials * trials))) / (1 + zz / trials)
    pmi = F.log(bound * F.lit(float(n)) / F.col("n_e"))
    scored = counted.withColumn("disclosure", F.when(ic > 0, pmi / ic)).where(F.col("disclosure") >= generalise)
    return scored.select("term", "e", "disclosure", F.when(F.col("disclosure") >= remove, "remove").otherwise("generalise").alias("action"))


def context_counts(rows: DataFrame, bits: DataFrame) -> DataFrame:
    """term, n_t: contexts of rows that hold a term whose bit is set, and all contexts as those of the term "".

    One pass over the corpus. Terms are summed where they are read, so that one row for each term and task is shuffled,
    and the bits are part of the condition: as a column they would be copied for each context.
    """
    lines = rows.select(F.explode(contexts(F.col("text"))).alias("line"))
    terms = lines.select(F.explode(F.array_append(terms_of(F.col("line")), F.lit(""))).alias("term"))
    return terms.where((F.col("term") == "") | marked(F.col("term"), bits.scalar())).groupBy("term").agg(F.count("*").alias("n_t"))


def slot_bits(terms: DataFrame, slots: int = SLOTS) -> DataFrame:
    """One row with so many bits, 64 to a number of an array, set at the hash values of the column term."""
    given = terms.select(_slot(F.col("term"), slots).alias("slot")).groupBy(F.shiftright("slot", 6).alias("id")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits"))
    words = terms.sparkSession.range(slots // 64).join(given, "id", "left").select("id", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))
    return words.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "bits"))), lambda x: x["bits"]).alias("bits"))


def _slot(term: Column, slots: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(slots))


def marked(term: Column, bits: Column, slots: int = SLOTS) -> Column:
    """Whether the bit of a term's hash value is set."""
    slot = _slot(term, slots)
    return F.getbit(F.get(bits, F.shiftright(slot, 6).cast("int")), slot.bitwiseAND(F.lit(63)).cast("int")) == 1


def term_spans(rows: DataFrame, telling: DataFrame) -> DataFrame:
    """id, tie and the spans (start, end, action) of telling terms (term, action) in every text that holds one.

    Texts are not shuffled: their terms are held against SLOTS bits (512 KB, whatever the number of terms), and only
    tokens that pass are joined with the terms, where what passed by chance falls out.
    """
    bits = slot_bits(telling)
    texts = rows.select("id", F.xxhash64("text").alias("tie"), "text", bits.scalar().alias("bits"))
    # Only lines with a term that passes are cut into tokens with their places.
    lines = let(F.split("text", "\n"), lambda ls: let(ends(F.transform(ls, lambda x: F.length(x) + 1)), lambda e: F.transform(ls, lambda x, i: F.struct((e[i] - F.length(x) - 1).alias("at"), x.alias("line")))))
    near = F.filter(lines, lambda x: F.exists(terms_of(x["line"]), lambda t: marked(t, F.col("bits"))))
    tokens = texts.select("id", "tie", F.explode(near).alias("x")).select("id", "tie", "x.at", F.explode(matches(F.col("x.line"), TOKEN, is_term)).alias("m"))
    word = stripped(F.col("m.value"))
    lead = F.instr(F.col("m.value"), word) - 1
    placed = tokens.select("id", "tie", (F.col("at") + F.col("m.start") + lead).alias("start"), F.length(word).alias("n"), F.lower(word).alias("term"))
    hits = placed.where(marked(F.col("term"), bits.scalar())).join(telling, "term").select("id", "tie", F.struct("start", (F.col("start") + F.col("n")).alias("end"), "action").alias("s"))
    return hits.groupBy("id", "tie").agg(F.array_sort(F.collect_set("s")).alias("terms"))


def find(docs: DataFrame, z: float = 1.0, generalise: float = 0.75, remove: float = 0.95, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, tie (a hash of the text), base and terms (arrays of spans) of every row."""
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    found = rows.select("id", F.xxhash64("text").alias("tie"), base_spans(F.col("text")).alias("spans"), "text")
    # Texts are kept only where a span was found, for their lines.
    found = staged(found.select("id", "tie", "spans", F.when(F.size("spans") > 0, F.col("text")).alias("text")), "spans")
    ents = staged(entities(found), "entities")
    telling = staged(disclosing_terms(rows, ents, z, generalise, remove).groupBy("term").agg(F.max("action").alias("action")), "telling")
    spans = term_spans(rows, telling).withColumnsRenamed({"id": "_id", "tie": "_tie"})
    out = found.drop("text").join(spans, F.col("id").eqNullSafe(F.col("_id")) & (F.col("tie") == F.col("_tie")), "left")
    return out.select("id", "tie", F.col("spans").alias("base"), F.coalesce("terms", F.array().cast("array<struct<start:int,end:int,action:string>>")).alias("terms"))


def report(docs: DataFrame, **how) -> DataFrame:
    """Counts of base spans per kind, a digest of them, and all spans, for every row."""
    found = find(docs, **how)
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    terms = F.transform("terms", lambda s: F.struct(F.lit(TERM).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    base = joined(F.col("base"))
    return found.select(F.col("id").alias("doc_id"), *[count(k) for k in KINDS], F.sha2(base, 256).alias("base_sha256"), F.concat_ws(",", F.when(base != "", base), F.when(F.size(terms) > 0, joined(terms))).alias("spans"), F.size("terms").cast("long").alias("n_term"))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs with every span replaced: base spans by <KIND>, generalised terms by <TERM>, removed terms by nothing. Overlapping spans are replaced together by the first one's mark."""
    found = find(docs, id_col=id_col, text_col=text_col, **how).distinct().withColumnsRenamed({"id": "_id", "tie": "_tie", "base": "_base", "terms": "_terms"})
    base, terms = found["_base"], found["_terms"]
    marks = F.concat(F.transform(base, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">")).alias("mark"))), F.transform(terms, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.when(s["action"] == "remove", F.lit("")).otherwise(F.lit("<TERM>")).alias("mark"))))
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    cut = F.aggregate(
        F.array_sort(marks),
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), s["mark"])).otherwise(acc["out"]).alias("out")),
        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))),
    )
    same = docs[id_col].eqNullSafe(found["_id"]) & (F.xxhash64(text) == found["_tie"])
    wide = docs.join(found, same, "left")
    return wide.select(*[F.when(F.size(base) + F.size(terms) > 0, cut).otherwise(docs[c]).alias(c) if c == text_col else docs[c] for c in docs.columns])
