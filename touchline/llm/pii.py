"""Personal data: patterns find protected entities, and corpus co-occurrence finds terms that disclose them.

The second part is information-theoretic sanitisation. Exact entities seldom recur, so what terms disclose is estimated at three levels:
the value in plain form (a card's digits), its class (an e-mail's domain, an address's network, a card's issuer, a number's area), and
its kind. Over N documents, an entity of n(e) documents carries log(N / n(e)) of information. A term in n(t) documents, n(t,e) of them with
the entity, leaves log(1 / P) of it, with P = (n(t,e) + PRIOR n(e) / N) / (n(t) + PRIOR), which shrinks rare terms to chance. A term that
leaves less than 1 / ``root`` is generalised to the kind of what it discloses, or removed where P is at least SURE, wherever it occurs: in
documents without the entity, too. Secrets (long keys of letters and digits) are protected entities besides the four base kinds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import perhaps, stage

#: fixed patterns; each possessive where that changes no match, so that time and stack stay linear in the text
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = list(PATTERNS)
#: a key of 32 characters or more; with a letter and a digit it counts as a secret
SECRET = r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{32,}+"
NAMES = [*KINDS, "secret", "term"]
#: code points of a term at least
TERM = 4
#: texts, near copies counted once, in which a term must share a document with the entity
SUPPORT = 8
#: documents by which a term's share of an entity is shrunk to the entity's share of all; share from which a term is removed
PRIOR, SURE = 10.0, 0.9
#: characters that end a term as white space does, and those that no term begins or ends with
BREAKS = "\t\n\x0b\x0c\r,;:!?\"()[]{}<>"
EDGES = ".'-_*"


def _found(text: Column, pattern: str) -> Column:
    """Matches with their places: array of (s, e, m), in code points."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int,m:string>>").alias("out"))

    def step(acc: Column, pair: Column) -> Column:
        s = acc["at"] + F.char_length(pair["g"])
        e = s + F.char_length(pair["m"])
        return F.struct(e.alias("at"), F.concat(acc["out"], F.array(F.struct(s.alias("s"), e.alias("e"), pair["m"].alias("m")))).alias("out"))

    pairs = F.zip_with(gaps, matches, lambda g, m: F.struct(g.alias("g"), m.alias("m")))
    return F.aggregate(F.filter(pairs, lambda p: p["m"].isNotNull()), zero, step, lambda acc: acc["out"])


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes: every second digit from the right doubled, minus 9 beyond 9; the sum ends in 0."""
    back = F.transform(F.split(F.reverse(digits), "", -1), lambda d, i: F.when(d == "", 0).otherwise(F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0))))
    return F.aggregate(back, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        short = F.transform(F.split(m, r"\.", -1), lambda p: F.ltrim(p, F.lit("0")))
        return F.forall(short, lambda p: F.when(F.char_length(p) < 3, True).when(F.char_length(p) == 3, p <= "255").otherwise(False))
    digits = _digits(m)
    if kind == "card":
        return F.when(F.char_length(digits).between(12, 19), _luhn(digits)).otherwise(False)
    return F.char_length(digits).between(9, 15) if kind == "phone" else F.lit(True)


def base_spans(text: Column) -> Column:
    """Array of (s, k, e, m): begin, number of the kind, end (exclusive), matched text; by begin, then kind. Leftmost matches that
    do not overlap others of their kind; matches that fail the kind's test are dropped, not tried again."""
    text = F.coalesce(text, F.lit(""))
    none = F.array().cast("array<struct<s:int,k:int,e:int,m:string>>")
    has = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+"))}
    digit = text.rlike("[0-9]")

    def part(k: int, kind: str) -> Column:
        ok = F.filter(_found(text, PATTERNS[kind]), lambda x: _valid(kind, x["m"]))
        own = F.transform(ok, lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e"), x["m"].alias("m")))
        return F.when(has.get(kind, digit), own).otherwise(none)

    return F.array_sort(F.concat(*[part(k, kind) for k, kind in enumerate(KINDS)]))


def protected_spans(text: Column) -> Column:
    """base_spans() and those of secrets (kind 4), in order."""
    text = F.coalesce(text, F.lit(""))
    keys = F.filter(_found(text, SECRET), lambda x: x["m"].rlike("[0-9]") & x["m"].rlike("[A-Za-z]"))
    own = F.transform(keys, lambda x: F.struct(x["s"].alias("s"), F.lit(len(KINDS)).alias("k"), x["e"].alias("e"), x["m"].alias("m")))
    return F.array_sort(F.concat(base_spans(text), F.when(text.rlike("[A-Za-z0-9_-]{32}"), own).otherwise(F.array().cast(SPANS))))


SPANS = "array<struct<s:int,k:int,e:int,m:string>>"
PLACES = "array<struct<s:int,e:int,what:int>>"


def _entities(spans: Column) -> Column:
    """Distinct (kind, entity) of the spans, at all levels; an entity is a hash of kind, level and value."""

    def levels(b: Column) -> Column:
        m, digits = F.lower(b["m"]), _digits(b["m"])
        plain = F.when(b["k"].isin(KINDS.index("card"), KINDS.index("phone")), digits).otherwise(m)
        network = F.substring_index(m, ".", 2)
        group = F.when(b["k"] == KINDS.index("email"), F.substring_index(m, "@", -1)).when(b["k"] == KINDS.index("ip"), network)
        group = group.when(b["k"] == KINDS.index("card"), F.substring(digits, 1, 6)).when(b["k"] == KINDS.index("phone"), F.substring(digits, 1, 4))
        entity = lambda level, value: F.struct(b["k"].alias("kind"), F.xxhash64(b["k"], F.lit(level), value).alias("entity"))
        return F.array(entity(0, F.lit("")), entity(1, F.coalesce(group, F.lit(""))), entity(2, plain))

    return F.array_distinct(F.flatten(F.transform(spans, levels)))


def _spaced(text: Column) -> Column:
    return F.translate(text, BREAKS, " " * len(BREAKS))


def _terms(spaced: Column) -> Column:
    """Hashes of the different terms of a text."""
    trimmed = F.transform(F.split(F.lower(spaced), " ", -1), lambda w: F.btrim(w, F.lit(EDGES)))
    return F.array_distinct(F.transform(F.filter(trimmed, lambda w: F.char_length(w) >= TERM), lambda w: F.xxhash64(w)))


def _beside(spaced: Column, base: Column) -> Column:
    """``spaced`` without the entities of ``base`` and the words that touch them."""
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    cut = lambda at, piece: F.when(at > 0, F.regexp_replace(piece, "^[^ ]+", "")).otherwise(piece)

    def step(acc: Column, b: Column) -> Column:
        piece = F.regexp_replace(cut(acc["at"], F.substring(spaced, acc["at"] + 1, b["s"] - acc["at"])), "[^ ]++$", "")
        return F.struct(F.greatest(acc["at"], b["e"]).alias("at"), F.concat(acc["out"], F.lit(" "), piece).alias("out"))

    done = F.aggregate(base, zero, step)
    return F.concat(done["out"], F.lit(" "), cut(done["at"], F.substring(spaced, done["at"] + 1, F.char_length(spaced))))


def _places(text: Column, spans: Column, told: Column) -> Column:
    """Array of (s, e, what): where terms of ``told`` (array of term, what) are in the text, outside protected spans."""
    terms, what = F.transform(told, lambda x: x["term"]), F.transform(told, lambda x: x["what"])
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(PLACES).alias("out"))

    def step(acc: Column, w: Column) -> Column:
        term = F.btrim(w, F.lit(EDGES))
        s = acc["at"] + F.char_length(w) - F.char_length(F.ltrim(w, F.lit(EDGES)))
        at = F.when(F.char_length(F.lower(term)) >= TERM, F.array_position(terms, F.xxhash64(F.lower(term)))).otherwise(0)
        own = F.struct(s.alias("s"), (s + F.char_length(term)).alias("e"), F.get(what, at.cast("int") - 1).alias("what"))
        return F.struct((acc["at"] + F.char_length(w) + 1).alias("at"), F.when(at > 0, F.concat(acc["out"], F.array(own))).otherwise(acc["out"]).alias("out"))

    found = F.aggregate(F.split(_spaced(text), " ", -1), zero, step, lambda acc: acc["out"])
    return F.filter(found, lambda t: ~F.exists(spans, lambda b: (b["s"] <= t["e"]) & (t["s"] <= b["e"])))


def disclosing(docs: DataFrame, root: int = 4, support: int = SUPPORT) -> tuple[DataFrame, DataFrame]:
    """Rows of ``docs`` with text_hash, text_crc32 and protected spans; and term (hash), what: -1 if it is to be removed, else the kind
    that it is generalised to. See sanitise()."""
    text = F.coalesce("text", F.lit(""))
    based = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), *_keys(), protected_spans(text).alias("protected"))
    beside = _terms(_beside(_spaced(F.col("text")), F.col("protected")))
    rows = based.select("doc_id", "text_hash", "text_crc32", "protected", F.when(F.size("protected") > 0, beside).alias("beside"))
    rows = stage(rows, "pii-spans")
    total = float(rows.count())
    held = rows.where(F.size("protected") > 0).select("beside", _signs(F.col("beside")).alias("sign"), F.inline(_entities(F.col("protected"))))
    entities = stage(held.groupBy("entity").agg(F.count("*").alias("n_e")).where(F.col("n_e") >= support), "pii-entities")
    # an entity's rows never meet: each brings its terms, these are summed by (term, entity), and only the sums meet what entities count
    pairs = perhaps(held, entities, "entity").select("kind", "entity", "sign", F.explode("beside").alias("term"))
    together = pairs.groupBy("term", "entity").agg(F.min("kind").alias("kind"), F.count("*").alias("n_te")).where(F.col("n_te") >= support)
    together = stage(together.join(entities.hint("merge"), "entity"), "pii-together")
    spread = docs.select(F.explode(_terms(_spaced(text))).alias("term"))
    counted = perhaps(spread, together, "term").groupBy("term").agg(F.count("*").alias("n_t"))
    p, share = F.col("n_e") / F.lit(total), (F.col("n_te") + PRIOR * F.col("n_e") / F.lit(total)) / (F.col("n_t") + PRIOR)
    left = share
    for _ in range(root - 1):
        left = left * share
    likely = together.join(counted.hint("merge"), "term").withColumn("share", share).where((F.col("share") > p) & (left >= p))
    likely = stage(likely.select("term", "entity", "kind", "share"), "pii-likely")
    # near copies are one piece of evidence: they mostly share the least of their terms' hashes
    signs = perhaps(perhaps(pairs.select("entity", "sign", "term"), likely, "term"), likely, "entity").distinct()
    signs = signs.groupBy("term", "entity").agg(F.count("*").alias("signs")).where(F.col("signs") >= support)
    sound = signs.join(likely.hint("merge"), ["term", "entity"])
    best = F.max(F.struct("share", (-F.col("kind")).alias("first")))
    flagged = sound.groupBy("term").agg(best.alias("b")).select("term", F.when(F.col("b.share") >= SURE, -1).otherwise(-F.col("b.first")).alias("what"))
    return rows.drop("beside"), stage(flagged, "pii-flagged")


def _signs(beside: Column) -> Column:
    """What near copies mostly have in common."""
    return F.coalesce(F.array_min(beside), F.lit(0))


def _keys() -> list[Column]:
    text = F.coalesce("text", F.lit(""))
    return [F.xxhash64(text).alias("text_hash"), F.crc32(text.cast("binary")).alias("text_crc32")]


def _disclosed(docs: DataFrame, root: int, support: int) -> tuple[DataFrame, DataFrame]:
    """The rows of disclosing(), and text_hash, text_crc32, terms of the texts that have disclosing terms."""
    text = F.coalesce("text", F.lit(""))
    rows, flagged = disclosing(docs, root, support)
    spread = docs.select(*_keys(), F.explode(_terms(_spaced(text))).alias("term"))
    told = perhaps(spread, flagged, "term").join(flagged.hint("merge"), "term").groupBy("text_hash", "text_crc32").agg(F.collect_set(F.struct("term", "what")).alias("told"))
    told = stage(told, "pii-told")
    hits = perhaps(docs.select(text.alias("text"), *_keys()), told, "text_hash").dropDuplicates(["text_hash", "text_crc32"]).join(told.hint("merge"), ["text_hash", "text_crc32"])
    return rows, stage(hits.select("text_hash", "text_crc32", _places(F.col("text"), protected_spans(F.col("text")), F.col("told")).alias("terms")), "pii-hits")


def sanitise(docs: DataFrame, root: int = 4, support: int = SUPPORT) -> DataFrame:
    """doc_id, text_crc32, base and secrets (arrays of s, k, e, m) and terms (array of s, e, what): places of entities and disclosing terms.

    A term is a run of at least TERM characters without white space or BREAKS, less EDGES at its ends, in lower case, touching no entity.
    It discloses an entity e (a value, class or kind) if it shares at least ``support`` documents with e, wherever in them and near copies
    counted once, and leaves at most 1 / ``root`` of e's information, by the estimate above; ``what`` is the kind of the entity that it
    tells most of, or -1 where it is so sure that the term is removed. All places of such a term in all documents are given, with the
    entity or without it. Counts are over all documents; n(t) counts documents that have the term anywhere. A null text is an empty
    one: no spans. A row in, a row out, also for repeated rows and doc_ids and null doc_ids. Terms and entities are counted by 64-bit
    hashes, and texts are told apart by one and a CRC-32.

    All steps are joins and sums: only entities of ``support`` documents bring pairs, (term, entity) pairs are first summed in each task,
    and join what is known of entities as sums; flagged terms join the terms of all texts. So no entity's documents and no term's are gathered. Joins sort and
    merge at every size, behind bitmaps of a fixed size.
    """
    rows, hits = _disclosed(docs, root, support)
    none = F.array().cast(PLACES)
    flagged = perhaps(rows, hits, "text_hash", keep="pii_perhaps")  # texts without such terms never move, null and empty ones neither
    some = flagged.where("pii_perhaps").join(hits.hint("merge"), ["text_hash", "text_crc32"], "left").withColumn("terms", F.coalesce("terms", none))
    found = some.unionByName(flagged.where("not pii_perhaps").withColumn("terms", none))
    side = lambda secret: F.filter("protected", lambda b: (b["k"] == len(KINDS)) == F.lit(secret))
    return found.select("doc_id", "text_crc32", side(False).alias("base"), side(True).alias("secrets"), "terms")


def sanitised(docs: DataFrame, root: int = 4, support: int = SUPPORT) -> DataFrame:
    """``docs`` with the text cleaned of what sanitise() finds, and n_chars to match if there is one. A null text stays null."""
    _, hits = _disclosed(docs, root, support)
    hits = hits.withColumnsRenamed({"text_hash": "pii_hash", "text_crc32": "pii_crc", "terms": "pii_terms"})
    whole = F.coalesce("text", F.lit(""))
    hashed = docs.withColumn("pii_hash", F.xxhash64(whole)).withColumn("pii_crc", F.crc32(whole.cast("binary")))
    hashed = perhaps(hashed, hits, "pii_hash", keep="pii_perhaps")
    joined = hashed.where("pii_perhaps").join(hits.hint("merge"), ["pii_hash", "pii_crc"], "left")
    none = F.array().cast(PLACES)
    spans = protected_spans(F.col("text"))

    def text(terms: Column) -> Column:
        return F.when(F.col("text").isNotNull(), cleaned(F.col("text"), spans, terms))

    out = joined.withColumn("text", text(F.coalesce("pii_terms", none))).select(*docs.columns).unionByName(hashed.where("not pii_perhaps").withColumn("text", text(none)).select(*docs.columns))
    return out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else out


def cleaned(text: Column, spans: Column, terms: Column) -> Column:
    """The text with each entity replaced by its kind in angle brackets, each disclosing term by the kind that it tells of (<email term>), or
    by nothing where it is to be removed. Where spans overlap, the first one (the longest of those that begin there) stands for all
    that it covers."""
    kind = lambda k: F.element_at(F.array(*map(F.lit, NAMES)), k + 1)
    marks = F.concat(
        F.transform(spans, lambda b: F.struct(b["s"].alias("s"), (-b["e"]).alias("back"), F.concat(F.lit("<"), kind(b["k"]), F.lit(">")).alias("put"))),
        F.transform(terms, lambda t: F.struct(t["s"].alias("s"), (-t["e"]).alias("back"), F.when(t["what"] < 0, "").otherwise(F.concat(F.lit("<"), kind(F.greatest(t["what"], F.lit(0))), F.lit(" term>"))).alias("put"))),
    )
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, m: Column) -> Column:
        piece = F.concat(acc["out"], F.substring(text, acc["at"] + 1, m["s"] - acc["at"]), m["put"])
        return F.struct(F.greatest(acc["at"], -m["back"]).alias("at"), F.when(m["s"] >= acc["at"], piece).otherwise(acc["out"]).alias("out"))

    done = F.aggregate(F.array_sort(marks), zero, step)
    return F.when(F.size(marks) == 0, text).otherwise(F.concat(done["out"], F.substring(text, done["at"] + 1, F.char_length(text))))


def digest(found: DataFrame) -> DataFrame:
    """doc_id, counts of base entities by kind, the digest of base spans, and all spans as text (kind:start:end; secret and term follow
    the base kinds)."""
    name = lambda k: F.element_at(F.array(*map(F.lit, NAMES)), k + 1)
    text = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", name(x["k"]), x["s"], x["e"])), ",")
    plain = lambda spans: F.transform(spans, lambda b: F.struct(b["s"].alias("s"), b["k"].alias("k"), b["e"].alias("e")))
    terms = F.transform("terms", lambda t: F.struct(t["s"].alias("s"), F.lit(len(NAMES) - 1).alias("k"), t["e"].alias("e")))
    of = lambda k: F.size(F.filter("base", lambda b: b["k"] == k)).cast("long")
    count = [of(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    every = F.array_sort(F.concat(plain("base"), plain("secrets"), terms))
    more = [F.size("secrets").cast("long").alias("n_secret"), F.size("terms").cast("long").alias("n_term")]
    return found.select("doc_id", *count, F.sha2(text(plain("base")).cast("binary"), 256).alias("base_sha256"), text(every).alias("spans"), *more)
