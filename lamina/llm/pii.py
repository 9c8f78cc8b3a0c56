"""Personal data and what reveals it: base patterns, then information-theoretic sanitisation. Built-in functions only.

Base: e-mail addresses, IP addresses, card numbers (Luhn) and phone numbers, leftmost and non-overlapping per kind. Places come
from splitting the text at the pattern: the pieces' and the matches' lengths add up to the starts. The patterns are written
without backtracking (possessive, anchored at the start of a run), which finds the same matches in linear time and without
deep recursion, whatever the text.

Sanitisation: the words of a document that holds an entity may give it away, wherever they stand. Over the corpus, with
document counts, the pointwise mutual information of term t and entity e, log2(n(t,e) N / (n(t) n(e))), is set against the
information content of e, log2(N / n(e)). A term seen with the entity in ``MIN_DOCS`` documents or more whose share
of that content reaches ``DISCLOSURE`` is a span wherever it stands, in all documents; from ``REMOVAL`` on it is
removed from the text, below it is generalised.

Scale. One pass over the texts writes the entities and words of the documents that hold any; a second one counts the
terms (distinct words per document, aggregated before the shuffle); then terms are paired with the entities of their
documents. As n(t,e) is at most n(e), a share of ``DISCLOSURE`` needs n(t) <= n(e) (N / n(e)) ** (1 - ``DISCLOSURE``): only
terms within that bound are paired, which loses none. The last pass is one projection of the texts, without a join: the
disclosing terms, if at most ``BROADCAST_TERMS`` (counted), come as a hash table from a scalar subquery. Beyond that, words are
joined to terms and what is found to the texts, by shuffle. Counts aggregate on the map side and joins split hot keys off
(``common.lookup``), so an entity in a third of all documents is no hot group.

Defined cases. A null text counts as empty: no spans, the digest of the empty string. Rows that repeat id and text
have the same spans and count separately as documents. Overlapping spans of different kinds are one replacement in
the sanitised text, named after the first. An empty table gives an empty result; other columns of the input are
left out (``sanitise`` keeps them).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import let, lookup, materialise, tidy

MIN_DOCS, DISCLOSURE, REMOVAL = 2, 0.9, 0.999
BROADCAST_TERMS = 200_000
#: Slots of the hash table of terms: as many as terms, at most this many.
SLOTS = 1 << 16

_PART = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: Kind, pattern (same matches as the plain one), and a test that is cheap to fail.
KINDS = (
    ("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda t: F.contains(t, F.lit("@"))),
    ("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", lambda t: t.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]")),
    ("card", r"[0-9](?:[ -]?[0-9])++", lambda t: t.rlike(r"[0-9](?:[ -]?[0-9]){15}")),
    ("phone", r"\+[0-9][ ().0-9-]+[0-9]", lambda t: F.contains(t, F.lit("+"))),
)
_WORD = r"[a-zA-Z\p{L}\p{M}]{4,}+"
#: Stands for a base span while the words are split: no letter, and no character of a text.
_CUT = "\ufdd0"
_SPANS = "array<struct<s:int,e:int>>"


def _name(number: Column) -> Column:
    return F.element_at(F.array(*(F.lit(k) for k, _, _ in KINDS), F.lit("term")), number + 1)


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def step(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        doubled = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 1, doubled).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), step) % 10 == 0


def _valid(kind: str, x: Column) -> Column:
    if kind == "ip":
        return x.rlike(rf"^0*{_PART}(?:\.0*{_PART}){{3}}$")
    if kind == "card":
        digits = F.regexp_replace(x, "[ -]", "")
        return F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(F.regexp_replace(x, "[^0-9]", "")).between(8, 15)
    return F.lit(True)


def places(text: Column, pattern: Column, valid) -> Column:
    """Start and end of every match that is valid."""

    def of(pieces: Column) -> Column:
        size = lambda i: F.length(F.get(pieces, i))
        return F.aggregate(
            F.regexp_extract_all(text, pattern, F.lit(0)),
            F.struct(size(F.lit(0)).alias("at"), F.lit(0).alias("i"), F.array().cast(_SPANS).alias("out")),
            lambda acc, x: F.struct(
                (acc["at"] + F.length(x) + size(acc["i"] + 1)).alias("at"),
                (acc["i"] + 1).alias("i"),
                F.when(valid(x), F.array_append(acc["out"], F.struct(acc["at"].alias("s"), (acc["at"] + F.length(x)).alias("e")))).otherwise(acc["out"]).alias("out"),
            ),
            lambda acc: acc["out"],
        )

    return let(F.split(text, pattern, -1), of)


def _of_kind(at: Column, k: int) -> Column:
    return F.transform(at, lambda x: F.struct(F.lit(k).alias("k"), x["s"].alias("s"), x["e"].alias("e")))


def base_spans(text: Column) -> Column:
    """Array of ``(kind number, s, e)``, by kind, then start."""
    found = []
    for k, (kind, pattern, test) in enumerate(KINDS):
        at = F.when(test(text), places(text, F.lit(pattern), lambda x, kind=kind: _valid(kind, x))).otherwise(F.array().cast(_SPANS))
        found.append(_of_kind(at, k))
    return F.concat(*found)


def _entities(text: Column, spans: Column) -> Column:
    """The distinct entities of a document."""
    return F.array_distinct(F.transform(spans, lambda x: F.concat(_name(x["k"]), F.lit(":"), F.lower(F.substring(text, x["s"] + 1, x["e"] - x["s"])))))


def _cut(text: Column, cuts: Column) -> Column:
    """``text`` with every one of the sorted ``(s, e, by)`` replaced; the first of those that overlap names them all."""
    return F.aggregate(
        cuts,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, x: F.struct(
            F.greatest(acc["at"], x["e"]).alias("at"),
            F.when(x["s"] >= acc["at"], F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["s"] - acc["at"]), x["by"])).otherwise(acc["out"]).alias("out"),
        ),
        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))),
    )


def _words(text: Column) -> Column:
    """The words of 4 letters or more."""
    return F.regexp_extract_all(text, F.lit(_WORD), F.lit(0))


def _terms(text: Column) -> Column:
    """The distinct words, lower-cased. Word by word only where a letter's lower case depends on its neighbours."""
    whole = F.array_distinct(_words(F.lower(text)))
    return F.when(F.contains(text, F.lit("\u03a3")), F.array_distinct(F.transform(_words(text), F.lower))).otherwise(whole)


def _free_words(text: Column, spans: Column) -> Column:
    """The distinct words, lower-cased, that no base span touches."""
    cuts = F.array_sort(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(_CUT).alias("by"))))
    words = F.regexp_extract_all(_cut(F.translate(text, _CUT, " "), cuts), F.lit(rf"[a-zA-Z\p{{L}}\p{{M}}{_CUT}]{{4,}}+"), F.lit(0))
    return F.array_distinct(F.transform(F.filter(words, lambda w: ~F.contains(w, F.lit(_CUT))), F.lower))


def _docs(df: DataFrame, text_col: str) -> DataFrame:
    return df.select(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))


@tidy("pii")
def disclosing(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Written table ``term, share``: the terms that give an entity away and the largest share."""
    docs = _docs(df, text_col)
    found = docs.withColumn("spans", base_spans(F.col("text"))).filter(F.size("spans") > 0)
    found = materialise(found.select(_entities(F.col("text"), F.col("spans")).alias("entities"), _free_words(F.col("text"), F.col("spans")).alias("words")), "base")
    n = float(docs.count())
    entities = found.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("n_e"))
    bound = F.col("n_e") * F.pow(F.lit(n) / F.col("n_e"), F.lit(1 - DISCLOSURE)) * (1 + 1e-9)
    entities = entities.filter((F.col("n_e") >= MIN_DOCS) & (F.col("n_e") < n)).withColumn("most", bound)
    entities = materialise(entities, "entities")
    most = entities.agg(F.max("most")).first()[0] or 0.0
    counted = docs.select(F.explode(_terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n_t"))
    counted = materialise(counted.filter(F.col("n_t").between(MIN_DOCS, most)), "terms")
    held = materialise(lookup(materialise(found.select(F.explode("entities").alias("entity"), "words"), "held"), entities, ["entity"]).filter("n_e is not null"), "known")
    pairs = held.select("entity", "n_e", "most", F.explode("words").alias("term"))
    if counted.count() > BROADCAST_TERMS:
        pairs = materialise(pairs, "pairs")
    pairs = lookup(pairs, counted, ["term"], BROADCAST_TERMS).filter("n_t <= most")
    together = pairs.groupBy("entity", "term", "n_e", "n_t").agg(F.count("*").alias("n_te")).filter(F.col("n_te") >= MIN_DOCS)
    share = F.log2(F.col("n_te") * n / (F.col("n_t") * F.col("n_e"))) / F.log2(F.lit(n) / F.col("n_e"))
    judged = together.select("term", share.alias("share")).filter(F.col("share") >= DISCLOSURE)
    return judged.groupBy("term").agg(F.max("share").alias("share"))


_TOLD = "array<struct<term:string,share:double>>"


def _slot(word: Column, slots: int) -> Column:
    return F.pmod(F.hash(word), F.lit(slots))


def _hash_table(told: DataFrame, slots: int) -> Column:
    """``told`` as an array of ``slots`` lists of terms, by a scalar subquery."""
    lists = told.groupBy(_slot(F.col("term"), slots).cast("long").alias("slot")).agg(F.collect_list(F.struct("term", "share")).alias("own"))
    every = told.sparkSession.range(slots).withColumnRenamed("id", "slot").join(lists, "slot", "left")
    row = F.struct("slot", F.coalesce("own", F.array().cast(_TOLD)).alias("own"))
    return every.agg(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["own"]).alias("table")).scalar()


def _term_spans(text: Column, spans: Column, told: Column) -> Column:
    """Where the terms of ``told`` stand in the text, outside the base spans, as ``(s, e, share)``."""

    def of(own: Column) -> Column:
        named = F.transform(own, lambda x: x["term"])
        written = F.filter(F.array_distinct(_words(text)), lambda w: F.array_contains(named, F.lower(w)))
        pattern = F.concat(F.lit(r"(?<![\p{L}\p{M}])(?:"), F.array_join(written, "|"), F.lit(r")(?![\p{L}\p{M}])"))
        at = places(text, pattern, lambda x: F.lit(True))
        apart = F.filter(at, lambda w: ~F.exists(spans, lambda b: (w["s"] < b["e"]) & (w["e"] > b["s"])))
        share = lambda w: F.element_at(F.map_from_entries(own), F.lower(F.substring(text, w["s"] + 1, w["e"] - w["s"])))
        return F.transform(apart, lambda w: F.struct(w["s"].alias("s"), w["e"].alias("e"), share(w).alias("share")))

    nothing = F.array().cast("array<struct<s:int,e:int,share:double>>")
    return let(told, lambda own: F.when(F.size(own) > 0, of(own)).otherwise(nothing))


def with_spans(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` as ``row``, with ``pii_text``, ``spans`` (kind number, s, e) and ``terms`` (s, e, share)."""
    told = disclosing(df, text_col)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), text.alias("pii_text"))
    n = told.count()
    none = F.array().cast(_TOLD)
    if not n:
        own = rows.withColumn("told", none)
    elif n <= BROADCAST_TERMS:
        slots = min(SLOTS, max(16, n))

        def held(table: Column) -> Column:
            at = lambda w: F.get(table, _slot(w, slots))
            return F.flatten(F.transform(F.filter(_terms(F.col("pii_text")), lambda w: F.size(at(w)) > 0), lambda w: F.filter(at(w), lambda x: x["term"] == w)))

        # The analyser takes no subquery inside a lambda; the optimiser puts it there, as the column is referred to once.
        own = rows.withColumn("table", _hash_table(told, slots)).select("row", "pii_text", let(F.col("table"), held).alias("told"))
    else:
        keyed = rows.withColumn("pii_key", F.xxhash64("pii_text"))
        words = materialise(keyed.select("pii_key", F.explode(_terms(F.col("pii_text"))).alias("term")).distinct(), "pii-words")
        holders = lookup(words, told, ["term"], 0).filter("share is not null").groupBy("pii_key").agg(F.collect_list(F.struct("term", "share")).alias("told"))
        own = keyed.join(holders, "pii_key", "left").withColumn("told", F.coalesce("told", none))
    spanned = own.select("row", "pii_text", "told", base_spans(F.col("pii_text")).alias("spans"))
    return spanned.select("row", "pii_text", "spans", _term_spans(F.col("pii_text"), F.col("spans"), F.col("told")).alias("terms"))


def _named(spans: Column) -> Column:
    return F.transform(spans, lambda x: F.concat_ws(":", _name(x["k"]), x["s"].cast("string"), x["e"].cast("string")))


def report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans`` per input row."""
    base = _named(F.col("spans"))
    terms = F.transform("terms", lambda x: F.concat_ws(":", F.lit("term"), x["s"].cast("string"), x["e"].cast("string")))
    count = lambda k: F.size(F.filter("spans", lambda x: x["k"] == k)).cast("long")
    counts = [count(k).alias(f"n_{kind}") for k, (kind, _, _) in enumerate(KINDS)]
    narrow = with_spans(df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")))
    return narrow.select("row.doc_id", *counts, F.sha2(F.array_join(base, ","), 256).alias("base_sha256"), F.array_join(F.concat(base, terms), ",").alias("spans"))


def sanitise(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The input with every span of its text replaced: base spans by ``[EMAIL]`` and the like, terms by ``[TERM]`` or nothing."""
    base = F.transform("spans", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.concat(F.lit("["), F.upper(_name(x["k"])), F.lit("]")).alias("by")))
    terms = F.transform("terms", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.when(x["share"] >= REMOVAL, "").otherwise("[TERM]").alias("by")))
    cuts = F.array_sort(F.concat(base, terms))
    found = with_spans(df, text_col).select("row", "pii_text", cuts.alias("pii_cuts"))
    kept = F.col("row").getField(text_col)
    clean = F.when(F.size("pii_cuts") == 0, kept.cast("string")).otherwise(_cut(F.col("pii_text"), F.col("pii_cuts")))
    return found.select(*(clean.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in df.columns))
