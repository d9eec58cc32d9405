"""Personal data: base patterns, and terms that the corpus shows to reveal protected values. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import let, packed, stored, unpacked

KINDS = ("email", "ip", "card", "phone")
#: Each kind as the contract words it, written so that no text takes more than linear time: a run is entered at its
#: start (or where the last match ended) and never given back.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"

#: A term of letters counts as seen with a value if it stands within so many words of it.
NEAR = 50
#: A term is disclosing if the share of the documents with the term that hold the value near it, drawn towards the value's
#: share of all documents with this weight, is so large, and if that tells so many bits more than the corpus does. So a
#: term that one document holds, near a value, is disclosing; one that another document without the value holds too, isn't;
#: and a corpus of a few hundred documents is too small to call a term rare.
LEAST_SHARE, LEAST_BITS, WEIGHT = 0.6, 8.0, 0.5
TERM = r"\p{L}[\p{L}\p{M}'’-]*"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def weigh(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), weigh) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        d = _digits(m)
        return F.when(F.length(d).between(16, 19), _luhn(d)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(m)).between(8, 15)
    return F.lit(True)


def _scan(items: Column, start: Column, step, kind: str) -> Column:
    """The state after each item, of type `kind`, in blocks of about the root of their number: an array grows by copies,
    so one pass over n items would copy n * n / 2 states, and this copies n ** 1.5."""
    none = F.array().cast(f"array<{kind}>")
    wide = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(items))).cast("int"))

    def grown(state: Column, x: Column) -> Column:
        after = step(state["at"], x)
        return F.struct(after.alias("at"), F.concat(state["out"], F.array(after)).alias("out"))

    def ran(block: Column, at: Column) -> Column:
        return F.aggregate(block, F.struct(at.alias("at"), none.alias("out")), grown, lambda s: s["out"])

    def headed(state: Column, block: Column) -> Column:
        return F.struct(F.aggregate(block, state["at"], step).alias("at"), F.concat(state["out"], F.array(state["at"])).alias("out"))

    def all_of(blocks: Column) -> Column:
        heads = F.aggregate(blocks, F.struct(start.alias("at"), none.alias("out")), headed, lambda s: s["out"])
        return F.flatten(F.zip_with(blocks, heads, ran))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / wide).cast("int")), lambda k: F.slice(items, k * wide + 1, wide))
    return F.when(F.size(items) > 0, let(blocks, all_of)).otherwise(none)


def _located(text: Column, pattern: Column, valid) -> Column:
    """Spans array<struct<start, end>> of a pattern's matches that are valid, in code points.

    The gaps between matches and the matches themselves, both from one left-to-right search, add up to the positions.
    """
    def of(both: Column) -> Column:
        gaps, found = both["gaps"], both["found"]
        steps = F.zip_with(F.slice(gaps, 1, F.size(gaps) - 1), found, lambda g, m: F.struct((F.length(g) + F.length(m)).alias("size"), F.length(m).alias("own"), valid(m).alias("ok")))
        ends = lambda x: _scan(x, F.lit(0), lambda at, y: at + y["size"], "int")
        placed = let(steps, lambda x: F.zip_with(ends(x), x, lambda end, y: F.struct((end - y["own"]).alias("start"), end.alias("end"), y["ok"].alias("ok"))))
        return F.transform(F.filter(placed, lambda y: y["ok"]), lambda y: F.struct(y["start"].alias("start"), y["end"].alias("end")))

    return let(F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, pattern, 0).alias("found")), of)


def _pieces(text: Column, spans: Column) -> Column:
    """For sorted spans array<struct<start, end, ...>> of a text: array<struct<gap, span, own, free>>, the text before each
    span that no span covers, the span, its own text, and whether it starts beyond all spans before it; a last one with
    null span has the rest. Linear in the text."""
    def of(c: Column) -> Column:
        chars, spans = c["chars"], c["spans"]
        cut = lambda lo, hi: F.array_join(F.slice(chars, lo + 1, F.greatest(hi - lo, F.lit(0))), "")
        reached = _scan(spans, F.lit(0), lambda at, x: F.greatest(at, x["end"]), "int")

        def made(ends: Column) -> Column:
            before = F.concat(F.array(F.lit(0)), ends)
            each = F.zip_with(F.slice(before, 1, F.size(spans)), spans, lambda at, x: F.struct(cut(at, x["start"]).alias("gap"), x.alias("span"), cut(x["start"], x["end"]).alias("own"), (x["start"] >= at).alias("free")))
            last = F.struct(cut(F.element_at(before, -1), F.size(chars)).alias("gap"), F.get(F.slice(spans, 1, 0), F.lit(0)).alias("span"), F.lit("").alias("own"), F.lit(True).alias("free"))
            return F.concat(each, F.array(last))

        return let(reached, made)

    return let(F.struct(F.split(text, "", -1).alias("chars"), spans.alias("spans")), of)


def base_spans(text: Column, kind: str) -> Column:
    """The contract's spans of one kind in a text, leftmost and not overlapping; failing matches are dropped."""
    empty = F.array().cast("array<struct<start:int,end:int>>")
    hint = {"email": text.contains("@"), "phone": text.contains("+"), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike(r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]")}[kind]
    return F.when(hint, _located(text, F.lit(PATTERNS[kind]), lambda m: _valid(kind, m))).otherwise(empty)


def with_base(docs: DataFrame) -> DataFrame:
    """docs with _text (null: empty), its hashes _h0 and _h1, and an array of spans for each kind."""
    text = F.coalesce("text", F.lit(""))
    return docs.withColumns({"_text": text, "_h0": F.xxhash64(text), "_h1": F.xxhash64(F.lit(1), text)} | {f"_{k}": base_spans(text, k) for k in KINDS})


def _words(part: Column) -> Column:
    return F.regexp_extract_all(F.lower(part), F.lit(TERM), 0)


def _tagged(kinds: tuple[str, ...], put) -> Column:
    """All spans of these kinds in order, with what put(kind) says."""
    def of(kind: str) -> Column:
        return F.transform(f"_{kind}", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(put(kind)).alias("put")))

    return F.array_sort(F.concat(*map(of, kinds)))


def _seen(docs: DataFrame, near: int) -> DataFrame:
    """(values, pairs) of each document with protected values: its different values, and "value\\nterm" for each different
    term within `near` words of one; what other values are made of doesn't count. Each value takes at most 2 * near words,
    wherever it stands, so what is made grows with the text."""
    spans = docs.where(F.size(F.concat(*[F.col(f"_{k}") for k in KINDS])) > 0).select(_pieces(F.col("_text"), _tagged(KINDS, lambda k: k)).alias("p"))

    def row(x: Column) -> Column:
        terms = F.transform(_words(x["gap"]), lambda w: F.struct(F.lit(False).alias("is"), w.alias("what")))
        value = F.array(F.struct(F.lit(True).alias("is"), F.concat_ws(":", x["span"]["put"], F.lower(x["own"])).alias("what")))
        return F.when(x["span"].isNull(), terms).otherwise(F.concat(terms, value))

    lines = spans.select(F.flatten(F.transform("p", row)).alias("line"))
    at = F.filter(F.sequence(F.lit(0), F.size("line") - 1), lambda i: F.get("line", i)["is"])

    def paired(i: Column) -> Column:
        around = F.filter(F.slice("line", F.greatest(i - near + 1, F.lit(1)), F.least(i, F.lit(near)) + near + 1), lambda x: ~x["is"])
        return F.transform(around, lambda x: F.concat(F.get("line", i)["what"], F.lit("\n"), x["what"]))

    values = F.array_distinct(F.transform(F.filter("line", lambda x: x["is"]), lambda x: x["what"]))
    return lines.select(values.alias("values"), F.array_distinct(F.flatten(F.transform(at, paired))).alias("pairs"))


def _holding(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(_h0, _h1, term): which of these terms each document holds, once each."""
    return docs.select("_h0", "_h1", F.explode(F.array_distinct(_words(F.col("_text")))).alias("term")).join(terms.select("term").distinct(), "term", "left_semi")


def disclosing_terms(docs: DataFrame, share=LEAST_SHARE, bits=LEAST_BITS, weight=WEIGHT, near=NEAR) -> DataFrame:
    """Terms that reveal protected values: (term, value, both, documents, share, bits), by corpus co-occurrence.

    docs is with_base() of documents. Of a term, documents counts those that hold it, anywhere, and both those that hold
    the value within `near` words of it; share is both / documents, drawn towards the value's share of all documents as if by
    `weight` more of them; bits is log2(share / the value's share of all documents), what the term tells of the value. All
    counts are combined before they are shuffled.
    """
    seen = stored(_seen(docs, near))
    holders = seen.select(F.explode("values").alias("value")).groupBy("value").agg(F.count("*").alias("holders"))
    pairs = seen.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("both"))
    pairs = stored(pairs.select(F.substring_index("pair", "\n", 1).alias("value"), F.substring_index("pair", "\n", -1).alias("term"), "both"))
    total = float(docs.count())
    # Every term is counted, not only those of pairs: counts are combined in their tasks, where a join would shuffle all words.
    counted = docs.select(F.explode(F.array_distinct(_words(F.col("_text")))).alias("term")).groupBy("term").agg(F.count("*").alias("documents"))
    found = pairs.join(counted, "term").join(holders, "value")
    usual = F.col("holders") / total
    found = found.withColumn("share", (F.col("both") + weight * usual) / (F.col("documents") + weight)).withColumn("bits", F.log2(F.col("share") / usual))
    return found.where((F.col("share") >= share) & (F.col("bits") >= bits)).select("term", "value", "both", "documents", "share", "bits")


def find(docs: DataFrame, share=LEAST_SHARE, bits=LEAST_BITS, weight=WEIGHT, near=NEAR) -> DataFrame:
    """docs' rows with _text, the base spans (_email, _ip, _card, _phone) and _term, the spans of disclosing terms.

    A disclosing term is found in every text that holds it as a whole word, in any case; its spans within a base span
    are left out. Null text is empty and has no spans; doc_ids play no part, null or repeated; repeated rows are judged
    each; empty tables work; docs' other columns pass through unless they are named like these.
    """
    based = with_base(docs).withColumn("_null", F.col("text").isNull()).drop("text")  # texts are shuffled once
    revealing = stored(disclosing_terms(based, share, bits, weight, near).select("term").distinct())
    empty = F.array().cast("array<struct<start:int,end:int>>")
    if revealing.isEmpty():
        return based.drop("_h0", "_h1").withColumn("_term", empty)
    # Terms hold letters, marks, ', ’ and - only: none of these is special in a pattern outside brackets.
    of = _holding(based, revealing).groupBy("_h0", "_h1").agg(F.array_join(F.array_sort(F.collect_set("term")), "|").alias("_terms"))
    # The same join at every size: `of` grows with the documents, so it is not broadcast where it happens to be small.
    based = based.join(stored(of).hint("merge"), ["_h0", "_h1"], "left").drop("_h0", "_h1")
    pattern = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{M}'’-])(?:"), F.col("_terms"), F.lit(r")(?![\p{L}\p{M}'’-])"))
    base = F.concat(*[F.col(f"_{k}") for k in KINDS])
    spans = F.filter(_located(F.col("_text"), pattern, lambda m: F.lit(True)), lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return based.withColumn("_term", F.when(F.col("_terms").isNotNull(), spans).otherwise(empty)).drop("_terms")


def _listed(kinds: tuple[str, ...]) -> Column:
    def of(kind: str) -> Column:
        return F.transform(f"_{kind}", lambda s: F.concat_ws(":", F.lit(kind), s["start"], s["end"]))

    return F.array_join(F.concat(*map(of, kinds)), ",")


def digest(docs: DataFrame, **thresholds) -> DataFrame:
    """The contract's columns: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    return find(docs.select("doc_id", "text"), **thresholds).select(
        "doc_id", *[F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(_listed(KINDS), 256).alias("base_sha256"), _listed((*KINDS, "term")).alias("spans"),
    )


def sanitise(docs: DataFrame, **thresholds) -> DataFrame:
    """docs with every span of text generalised to its kind, as in <email>, and disclosing terms removed.

    Where spans overlap, what they cover goes once. Text without spans stays as it is, null included; n_chars, if docs
    has that column, follows. docs' columns are returned.
    """
    found = find(packed(docs, "text", apart="text"), **thresholds)
    pieces = _pieces(F.col("_text"), _tagged((*KINDS, "term"), lambda kind: "" if kind == "term" else f"<{kind}>"))

    put = lambda x: F.concat(x["gap"], F.when(x["free"], F.coalesce(x["span"]["put"], F.lit(""))).otherwise(F.lit("")))
    clean = F.array_join(F.transform(pieces, put), "")
    out = found.withColumn("_changed", F.size(F.concat(*[F.col(f"_{k}") for k in (*KINDS, "term")])) > 0).withColumn("_clean", F.when(F.col("_changed"), clean).when(~F.col("_null"), F.col("_text")))
    changed = {"text": F.col("_clean")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("_changed"), F.char_length("_clean")).otherwise(F.col("_row.n_chars"))
    return unpacked(out, docs, **changed)
