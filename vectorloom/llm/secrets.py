"""Secret scans in DataFrame operations only.

Base kinds are regular expressions. The method adds ``random`` spans: tokens that pass a battery of
randomness tests under the alphabet of their inferred encoding and that ordinary text is unlikely to
give, at a false discovery rate controlled per class of length.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vectorloom.llm.shared import cut, free_name

# The base kinds, in order, as (name, pattern, least length of the group, group).
BASE_KINDS = (
    (
        "assign",
        r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        12,
        2,
    ),
    ("access", r"AKIA[A-Z0-9]+", 18, 0),
    ("hex", r"[0-9a-f]+", 16, 0),
)
#: Patterns with the same matches of at least the least length, where short matches never hide long ones.
_FAST = {"access": r"AKIA[A-Z0-9]{14,}", "hex": r"[0-9a-f]{16,}"}
#: Tokens that the randomness battery looks at; which of them are reported is decided for each class of length.
TOKEN = r"[A-Za-z0-9+/_-]{12,}={0,2}"
#: Encodings from narrow to wide: (name, pattern, alphabet size, chance that two neighbours differ in class).
ENCODINGS = (
    ("hex", r"^([0-9a-f]+|[0-9A-F]+)$", 16, 0.469),
    ("base32", r"^[A-Z2-7]+={0,2}$", 32, 0.305),
    ("alnum", r"^[A-Za-z0-9]+$", 62, 0.622),
    ("base64", r"^[A-Za-z0-9+/]+={0,2}$", 64, 0.645),
    ("base64url", r"^[A-Za-z0-9_-]+={0,2}$", 64, 0.645),
)
#: Chance that two letters of ordinary text are equal, and that two neighbours differ in class.
TEXT_COINCIDENCE, TEXT_CHANGE = 0.066, 0.06
#: Each test of the battery rejects randomness below this probability.
BATTERY_LEVEL = 0.001
FALSE_DISCOVERY_RATE = 0.01


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


_SPAN = "array<struct<s:int,e:int,tok:string>>"
_CHUNK = 256


def _folded(items: Column, state: Column, step: Callable[[Column, Column], tuple[Column, Column]], kind: str) -> Column:
    """What step(state, item) -> (state, element or null) gives along an array: the elements, as an array of type kind.

    Elements are gathered chunk by chunk, so that a long array is not copied for each of them.
    """
    start = lambda at, out: F.struct(at.alias("at"), out.alias("out"))
    none, nested = F.from_json(F.lit("[]"), kind), F.from_json(F.lit("[]"), f"array<{kind}>")

    def one(acc: Column, item: Column) -> Column:
        after, made = step(acc["at"], item)
        return _let(F.struct(after.alias("after"), made.alias("made")), lambda x: start(x["after"], F.when(x["made"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(x["made"])))))

    def over(all_items: Column) -> Column:
        def chunk(acc: Column, k: Column) -> Column:
            inner = F.aggregate(F.slice(all_items, k, _CHUNK), start(acc["at"], none), one)
            return _let(inner, lambda x: start(x["at"], F.concat(acc["out"], F.array(x["out"]))))

        firsts = F.when(F.size(all_items) > 0, F.sequence(F.lit(1), F.greatest(F.size(all_items), F.lit(1)), F.lit(_CHUNK))).otherwise(F.array().cast("array<int>"))
        return F.flatten(F.aggregate(firsts, start(state, nested), chunk, lambda acc: acc["out"]))

    return _let(items, over)


def spans(text: Column, pattern: str, keep: Callable[[Column], Column]) -> Column:
    """Array of (s, e, tok) of the leftmost non-overlapping matches, in code points, end exclusive.

    The pieces between matches give the positions as running sums; these go chunk by chunk, so that
    long arrays are not copied for each match.
    """
    pieces = F.zip_with(
        F.split(text, pattern, -1),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda gap, tok: F.struct(F.char_length(gap).alias("gap"), F.char_length(tok).alias("n"), tok.alias("tok")),
    )

    def step(at: Column, p: Column) -> tuple[Column, Column]:
        s = at + p["gap"]
        e = s + F.coalesce(p["n"], F.lit(0))
        return e, F.when(p["tok"].isNotNull() & keep(p["tok"]), F.struct(s.alias("s"), e.alias("e"), p["tok"].alias("tok")))

    located = lambda all_pieces: _folded(all_pieces, F.lit(0), step, _SPAN)
    return F.when(F.regexp_like(text, F.lit(pattern)), _let(pieces, located)).otherwise(F.from_json(F.lit("[]"), _SPAN))


def _normal_tail(z: Column) -> Column:
    """Two-sided tail of the normal distribution (Abramowitz and Stegun 7.1.26)."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.3275911) * x)
    series = F.lit(0.0)
    for a in (1.061405429, -1.453152027, 1.421413741, -0.284496736, 0.254829592):
        series = (series + F.lit(a)) * t
    return series * F.exp(-x * x)


def _divergence(p: Column, q: float) -> Column:
    """Kullback-Leibler divergence of two coins."""
    part = lambda a, b: F.when(a > 0, a * F.ln(a / F.lit(b))).otherwise(F.lit(0.0))
    return part(p, q) + part(F.lit(1.0) - p, 1.0 - q)


def battery(tok: Column) -> Column:
    """(enc, n, p, uniform) of a token.

    uniform: none of three tests rejects that its characters are drawn evenly from the alphabet of its
    encoding: chi-squared of the character counts, runs of character classes, lag-one serial
    correlation. p: how likely ordinary text is to be so even and so mixed (two bounds, combined).
    """
    alphabet = F.lit(None).cast("int")
    change = F.lit(None).cast("double")
    name = F.lit(None).cast("string")
    for enc, pattern, size, differ in reversed(ENCODINGS):
        fits = F.regexp_like(tok, F.lit(pattern))
        name = F.when(fits, F.lit(enc)).otherwise(name)
        alphabet = F.when(fits, F.lit(size)).otherwise(alphabet)
        change = F.when(fits, F.lit(differ)).otherwise(change)
    body = F.rtrim(tok, F.lit("="))

    def judged(x: Column) -> Column:
        chars = F.filter(F.split(x["body"], ""), lambda c: c != "")

        def measured(m: Column) -> Column:
            n = F.size(m["chars"]).cast("double")
            # equal pairs, from the lengths of runs in sorted order
            pairs = F.aggregate(
                F.array_sort(m["chars"]),
                F.struct(F.lit("").alias("last"), F.lit(0).cast("long").alias("run"), F.lit(0).cast("long").alias("pairs")),
                lambda a, c: _let(
                    F.when(c == a["last"], a["run"] + 1).otherwise(F.lit(0).cast("long")),
                    lambda run: F.struct(c.alias("last"), run.alias("run"), (a["pairs"] + run).alias("pairs")),
                ),
                lambda a: a["pairs"].cast("double"),
            )
            kind = lambda c: F.when(c.between("a", "z"), 0).when(c.between("A", "Z"), 1).when(c.between("0", "9"), 2).otherwise(3)
            # the sequence as numbers: code points spread over the alphabet
            value = F.transform(m["chars"], lambda c: F.ascii(c).cast("double"))
            kinds = F.transform(m["chars"], kind)

            def tested(t: Column) -> Column:
                changes = F.aggregate(
                    F.zip_with(t["kinds"], F.slice(t["kinds"], 2, F.greatest(F.size(t["kinds"]) - 1, F.lit(0))), lambda a, b: F.coalesce((a != b).cast("int"), F.lit(0))),
                    F.lit(0),
                    lambda a, b: a + b,
                ).cast("double")
                mean = F.aggregate(t["value"], F.lit(0.0), lambda a, b: a + b) / n
                centred = F.transform(t["value"], lambda v: v - mean)
                spread = F.aggregate(t["value"], F.lit(0.0), lambda a, v: a + (v - mean) * (v - mean))
                lagged = _let(
                    centred,
                    lambda c: F.aggregate(
                        F.zip_with(c, F.slice(c, 2, F.greatest(F.size(c) - 1, F.lit(0))), lambda a, b: a * F.coalesce(b, F.lit(0.0))), F.lit(0.0), lambda a, b: a + b
                    ),
                )
                serial = F.when(spread > 0, lagged / spread).otherwise(F.lit(1.0))
                size, differ = x["alphabet"].cast("double"), x["change"]
                chi = size * (2.0 * t["pairs"] + n) / n - n
                chi_z = (chi - (size - 1)) / F.sqrt(2.0 * (size - 1) * (1.0 - 1.0 / n))
                runs_z = (changes - (n - 1) * differ) / F.sqrt((n - 1) * differ * (1.0 - differ))
                serial_z = (serial + 1.0 / n) * F.sqrt(n)
                # only too few or too many of one character speaks against it, not too even counts
                uniform = (
                    (F.when(chi_z > 0, _normal_tail(chi_z)).otherwise(F.lit(1.0)) >= BATTERY_LEVEL)
                    & (_normal_tail(runs_z) >= BATTERY_LEVEL)
                    & (_normal_tail(serial_z) >= BATTERY_LEVEL)
                )
                expected = n * (n - 1) / 2 * TEXT_COINCIDENCE
                even = F.when(
                    t["pairs"] < expected,
                    -(expected - t["pairs"] + F.when(t["pairs"] > 0, t["pairs"] * F.ln(t["pairs"] / expected)).otherwise(F.lit(0.0))),
                ).otherwise(F.lit(0.0))
                rate = changes / (n - 1)
                mixed = F.when(rate > TEXT_CHANGE, -(n - 1) * _divergence(rate, TEXT_CHANGE)).otherwise(F.lit(0.0))
                # Fisher: twice the sum of -ln p is chi-squared with four degrees of freedom
                half = -(even + mixed)
                p = F.exp(-half) * (1.0 + half)
                return F.struct(x["name"].alias("enc"), n.cast("int").alias("n"), p.alias("p"), uniform.alias("uniform"))

            return _let(F.struct(value.alias("value"), kinds.alias("kinds"), pairs.alias("pairs")), tested)

        return _let(F.struct(chars.alias("chars")), measured)

    return _let(F.struct(body.alias("body"), name.alias("name"), alphabet.alias("alphabet"), change.alias("change")), judged)


def _length_class(n: Column) -> Column:
    return F.least(F.floor(F.log2(n.cast("double"))), F.lit(10)).cast("int")


#: p values are compared in steps of a factor 10^(1/20), down to 10^-40.
_STEPS, _DEEPEST = 20, 800


def _step(p: Column) -> Column:
    return F.least(F.floor(-F.log10(F.greatest(p, F.lit(1e-300))) * _STEPS), F.lit(_DEEPEST)).cast("int")


def _cutoffs(cands: DataFrame, rate: float) -> dict[int, int]:
    """For each length class the step from which tokens are reported (Benjamini-Hochberg over steps)."""
    tokens = cands.select(F.explode("cands").alias("c")).select(_length_class(F.col("c.n")).alias("size"), _step(F.col("c.p")).alias("step"))
    counts = tokens.groupBy("size", "step").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("size").orderBy(F.col("step").desc())
    counts = counts.withColumn("found", F.sum("n").over(w)).withColumn("all", F.sum("n").over(Window.partitionBy("size")))
    fits = counts.where(F.pow(F.lit(10.0), -F.col("step") / _STEPS) * F.col("all") <= rate * F.col("found"))
    # at most 11 classes
    return {r["size"]: r["step"] for r in fits.groupBy("size").agg(F.min("step").alias("step")).collect()}


def _clear(base: Column, tokens: Column) -> Column:
    """The tokens that no base span overlaps, in one sweep over both in order of their starts."""
    none = F.lit(None)
    event = lambda s, e, tok: F.struct(s.cast("int").alias("s"), e.cast("int").alias("e"), tok.cast("string").alias("tok"))
    # at one start base spans come first (a null sorts before a text); an end without a text comes last
    events = F.array_sort(F.concat(F.transform(base, lambda b: event(b["s"], b["e"], none)), F.transform(tokens, lambda t: event(t["s"], t["e"], t["tok"]))))
    events = F.concat(events, F.array(event(F.lit(2**31 - 1), F.lit(2**31 - 1), none)))
    held = "struct<s:int,e:int,tok:string>"
    state = F.struct(F.lit(0).alias("reach"), F.lit(None).cast(held).alias("held"))

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        # a token waits until something starts at or after its end; a base span that starts earlier drops it
        over = at["held"].isNotNull() & (x["s"] >= at["held"]["e"])
        waits = F.when(at["held"].isNotNull() & ~over & x["tok"].isNotNull(), at["held"])
        after = F.struct(
            F.when(x["tok"].isNull(), F.greatest(at["reach"], x["e"])).otherwise(at["reach"]).alias("reach"),
            F.when(x["tok"].isNotNull() & (x["s"] >= at["reach"]), x).otherwise(waits).cast(held).alias("held"),
        )
        return after, F.when(over, at["held"])

    return _folded(events, state, step, _SPAN)


def _spans_of(text: Column) -> Column:
    """Struct of base (s, k, e) and cands (s, e, n, p) of a text."""

    def listed(name: str, found: Column) -> Column:
        return F.transform(found, lambda x: F.struct(x["s"].alias("s"), F.lit(_ORDER[name]).alias("k"), x["e"].alias("e")))

    kinds = []
    for name, pattern, least, group in BASE_KINDS:
        length = (lambda p, g: lambda tok: F.char_length(F.regexp_extract(tok, p, g)))(pattern, group) if group else F.char_length
        kinds.append(listed(name, spans(text, _FAST.get(name, pattern), lambda tok, f=length, m=least: f(tok) >= m)))
    found = F.struct(F.array_sort(F.concat(*kinds)).alias("base"), spans(text, TOKEN, lambda tok: F.lit(True)).alias("tokens"))

    def judged(x: Column) -> Column:
        clear = F.when(F.size(x["tokens"]) == 0, x["tokens"]).when(F.size(x["base"]) == 0, x["tokens"]).otherwise(_clear(x["base"], x["tokens"]))
        cands = F.transform(clear, lambda t: F.struct(t["s"].alias("s"), t["e"].alias("e"), battery(t["tok"]).alias("b")))
        cands = F.filter(cands, lambda t: t["b"]["enc"].isNotNull())
        cands = F.transform(cands, lambda t: F.struct(t["s"].alias("s"), t["e"].alias("e"), t["b"]["n"].alias("n"), F.when(t["b"]["uniform"], t["b"]["p"]).otherwise(F.lit(1.0)).alias("p")))
        return F.struct(x["base"].alias("base"), cands.alias("cands"))

    return _let(found, judged)


def _every(base: Column, cands: Column, steps: dict[int, int]) -> Column:
    """All spans (s, k, e): base ones, and candidates that reach their class's step."""
    passes = lambda x: F.coalesce(_step(x["p"]) >= _needed(steps, _length_class(x["n"])), F.lit(False))
    extra = F.transform(F.filter(cands, passes), lambda x: F.struct(x["s"].alias("s"), F.lit(_ORDER["random"]).alias("k"), x["e"].alias("e")))
    return F.array_sort(F.concat(base, extra))


_ORDER = {name: i for i, name in enumerate([*[k[0] for k in BASE_KINDS], "random"])}


def scan_secrets(docs: DataFrame, rate: float = FALSE_DISCOVERY_RATE) -> DataFrame:
    """One row per row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random, found.

    found: array of (s, e, kind) by start, then kind in order (assign, access, hex, random); spans: the
    same as text. Random spans never overlap base ones. A null or empty text has no spans; repeated
    rows each get a row; a null doc_id stays null; an empty table gives none; other columns are ignored.
    """
    base_names = [k[0] for k in BASE_KINDS]
    rows = docs.select("doc_id", _spans_of(F.coalesce(F.col("text"), F.lit(""))).alias("x"))
    # one pass over the texts; what follows reads this small table
    scanned = cut(rows.select("doc_id", "x.base", "x.cands"), "secrets")
    steps = _cutoffs(scanned, rate)
    names = F.array(*[F.lit(n) for n in _ORDER])
    spelled = lambda col: F.array_join(F.transform(col, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"], x["e"])), ",")
    count = lambda col, name: F.size(F.filter(col, lambda x: x["k"] == _ORDER[name])).cast("long")
    return scanned.withColumn("every", _every(F.col("base"), F.col("cands"), steps)).select(
        "doc_id",
        *[count(F.col("base"), n).alias(f"n_{n}") for n in base_names],
        F.sha2(spelled(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        spelled(F.col("every")).alias("spans"),
        count(F.col("every"), "random").alias("n_random"),
        F.transform("every", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.element_at(names, x["k"] + 1).alias("kind"))).alias("found"),
    )


def _needed(steps: dict[int, int], size: Column) -> Column:
    out = F.lit(None).cast("int")
    for k, step in steps.items():
        out = F.when(size == k, F.lit(step)).otherwise(out)
    return out


MASK = "[secret]"


def redact_secrets(docs: DataFrame, rate: float = FALSE_DISCOVERY_RATE) -> DataFrame:
    """docs, all columns, with every span of a secret in text replaced by ``[secret]`` and n_chars kept true.

    Overlapping spans give one mask. Null texts stay null; rows are never dropped, repeated ones stay; an
    empty table stays empty. Columns of any other name are kept as they are. Texts are scanned once: the rows
    are written with their spans, of which the cut-offs are made, and masked from there.
    """
    found, full = free_name(docs, "_found"), free_name(docs, "_text")
    marked = cut(docs.withColumn(found, _spans_of(F.coalesce(F.col("text"), F.lit("")))), "marked")
    steps = _cutoffs(marked.select(F.col(f"{found}.cands").alias("cands")), rate)
    marked = marked.withColumn(full, F.coalesce(F.col("text"), F.lit(""))).withColumn(found, _every(F.col(f"{found}.base"), F.col(f"{found}.cands"), steps))
    text, masked = F.col(full), F.size(F.col(found)) > 0

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        # what stands before a span and its mask; nothing more where spans overlap
        gap = F.concat(F.substring(text, at + 1, x["s"] - at), F.lit(MASK))
        return F.greatest(at, x["e"]), F.when(x["s"] >= at, F.struct(gap.alias("piece"))).when(x["s"] < at, F.lit(None))

    pieces = _folded(F.col(found), F.lit(0), step, "array<struct<piece:string>>")
    rest = F.expr(f"substring(`{full}`, array_max(transform(`{found}`, x -> x.e)) + 1, char_length(`{full}`))")
    changed = F.when(masked, F.concat(F.array_join(F.transform(pieces, lambda x: x["piece"]), ""), rest)).otherwise(F.col("text"))
    out = marked.withColumn("text", changed)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(masked, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
