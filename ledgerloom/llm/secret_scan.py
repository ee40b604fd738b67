"""Secrets by patterns and by sliding-window entropy, in Spark expressions only."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import without

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_HINTS = ("passw", "secret", "token", "apikey", "api_key")
ACCESS = "AKIA[A-Z0-9]{16,}"  # a failing run holds no longer match, so the length can stand in the pattern
HEX = "[0-9a-f]{24,}"
_C = "[A-Za-z0-9+/_=-]"
LONG_RUN = rf"[^A-Za-z0-9+/_=-]{_C}{{20}}"  # tried once a word, behind what is before it; every hex match and candidate has one
CANDIDATE = rf"(?<!{_C})(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z]){_C}{{20,}}"
WINDOW = 20
#: Least entropy of the fullest window, in bits a character, by the class of the candidate's characters.
THRESHOLDS = {"hex": 3.0, "alnum": 3.7, "base64": 3.8}
#: Candidates that look random but are no secrets: UUIDs, dotted or dashed words and numbers, placeholders, counting.
#: Repetitions are possessive: what follows them begins with another character, and long candidates need no deep stack.
ALLOWED = ("^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$", "^[A-Za-z]*+([-_/=+][A-Za-z]*+)*+[0-9]{0,4}$", "^[0-9]++([-_/=+][0-9A-Za-z]{1,4}+)*+$", "(?i)example|placeholder|changeme|x{6}|0123456|abcdefg")
_FIRST = ord("+")
MARK = "[SECRET]"


_RUN = 128
_SPAN = "struct<start:int,rank:int,end:int,kind:string>"
_LANES, _BITS = 10, 7  # counts of 7 bits, eight of them in a long: 80 characters in 10 longs


def _let(value: Column, f) -> Column:
    """f of a value that is worked out once: a lambda's variable, not an expression repeated inside other lambdas."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _running(values: Column, merge, run: int = _RUN) -> Column:
    """merge (of ints, from 0: a sum or a maximum) of all values before each one, and of all values at the end.

    One entry more than `values`. In two levels, runs of `run` values: appending to one array of all would cost the square
    of their number.
    """
    none = F.expr("cast(array(0) as array<int>)")
    onward = lambda own, first: F.aggregate(own, F.array(first), lambda out, v: F.array_append(out, merge(F.element_at(out, -1), v)))
    cut = lambda own: F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.size(own) / run).cast("int") - 1)), lambda i: F.slice(own, i * run + 1, run))
    totals = lambda runs: F.transform(runs, lambda r: F.aggregate(r, F.lit(0), merge))
    each = lambda runs, first: F.flatten(F.transform(runs, lambda r, i: F.slice(onward(r, F.get(first, i)), 1, F.size(r))))
    whole = lambda runs: _let(onward(totals(runs), F.lit(0)), lambda first: F.array_append(each(runs, first), F.element_at(first, -1)))
    return _let(values, lambda own: F.when(F.size(own) == 0, none).otherwise(_let(cut(own), whole)))


def _spans(text: Column, pattern: str, kind: str, keep=None) -> Column:
    """array<struct(start, rank, end, kind)> of a pattern's matches, from the lengths of matches and of what lies between.

    The text is matched and split once; the places are running sums of the lengths, so the work grows with the text.
    """
    rank, own = F.lit(KINDS.index(kind)), F.lit(kind)

    def place(found: Column, gaps: Column) -> Column:
        steps = _running(F.transform(found, lambda m, i: F.get(gaps, i) + F.length(m)), lambda a, b: a + b)
        span = lambda ends, m, i: F.struct((F.get(ends, i) + F.get(gaps, i)).alias("start"), rank.alias("rank"), F.get(ends, i + 1).alias("end"), own.alias("kind"))
        if keep is None:
            return _let(steps, lambda ends: F.transform(found, lambda m, i: span(ends, m, i)))
        judged = _let(steps, lambda ends: F.transform(found, lambda m, i: F.struct(keep(m).alias("keep"), span(ends, m, i).alias("span"))))
        return F.transform(F.filter(judged, lambda j: F.coalesce(j["keep"], F.lit(False))), lambda j: j["span"])

    gaps = F.transform(F.split(text, pattern, -1), F.length)
    return _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: _let(gaps, lambda g: place(found, g)))


def _information(n: int) -> float:
    return n * math.log2(n) if n > 1 else 0.0


def window_entropy(candidate: Column, window: int = WINDOW) -> Column:
    """Largest Shannon entropy, bits a character, of any window of a candidate (ASCII from + to z, window up to 31).

    Counts per character move with the window: the one that enters and the one that leaves change two counts and, by
    differences, the sum of n * log2(n). The counts are packed into a few longs, so a step costs the same for every
    window and candidate length. Null for a candidate shorter than the window.
    """
    if not 0 < window < 1 << _BITS:
        raise ValueError("the counts hold windows of 1 to 127 characters")
    info = F.array(*[F.lit(_information(n)) for n in range(window + 2)])
    names = [f"c{j}" for j in range(_LANES)]
    first = F.struct(*[F.lit(0).cast("long").alias(n) for n in names], F.lit(0).alias("i"), F.lit(0.0).alias("sum"), F.lit(float("inf")).alias("least"))
    lane = lambda code: F.shiftright(code, 3)
    place = lambda code: code.bitwiseAND(F.lit(7)) * _BITS
    unit = lambda code: F.call_function("shiftleft", F.lit(1).cast("long"), place(code))
    count = lambda state, code: F.call_function("shiftright", F.get(F.array(*[state[x] for x in names]), lane(code)), place(code)).bitwiseAND(F.lit((1 << _BITS) - 1).cast("long")).cast("int")
    moved = lambda state, code, sign: [F.when(lane(code) == j, state[x] + unit(code) * sign).otherwise(state[x]).alias(x) for j, x in enumerate(names)]

    def over(codes: Column) -> Column:
        def enter(state: Column, code: Column) -> Column:
            total = _let(count(state, code), lambda n: state["sum"] + F.get(info, n + 1) - F.get(info, n))
            return F.struct(*moved(state, code, 1), (state["i"] + 1).alias("i"), total.alias("sum"), state["least"].alias("least"))

        def leave(state: Column) -> Column:
            left = lambda code: F.struct(*moved(state, code, -1), state["i"].alias("i"), _let(count(state, code), lambda n: state["sum"] + F.get(info, n - 1) - F.get(info, n)).alias("sum"), state["least"].alias("least"))
            return _let(F.get(codes, state["i"] - window - 1), left)

        def settle(state: Column) -> Column:
            least = F.when(state["i"] >= window, F.least(state["least"], state["sum"])).otherwise(state["least"])
            return F.struct(*[state[x].alias(x) for x in names], state["i"].alias("i"), state["sum"].alias("sum"), least.alias("least"))

        step = lambda state, code: _let(enter(state, code), lambda s: _let(F.when(s["i"] > window, leave(s)).otherwise(s), settle))
        best = F.aggregate(codes, first, step, lambda s: F.lit(math.log2(window)) - s["least"] / F.lit(float(window)))
        return F.when(F.size(codes) >= window, best)

    return _let(F.transform(F.split(candidate, ""), lambda c: F.ascii(c) - F.lit(_FIRST)), over)


def is_random(candidate: Column, window: int = WINDOW, thresholds: dict[str, float] = THRESHOLDS) -> Column:
    """Whether a candidate's fullest window reaches its class's entropy and no allow-list pattern holds for it.

    Candidates have a digit and a letter: runs of letters alone count as words, and of digits alone as numbers.
    """
    limit = F.when(candidate.rlike("^[0-9a-f]+$") | candidate.rlike("^[0-9A-F]+$"), thresholds["hex"]).when(candidate.rlike("^[0-9A-Za-z]+$"), thresholds["alnum"]).otherwise(thresholds["base64"])
    allowed = F.lit(False)
    for pattern in ALLOWED:
        allowed = allowed | candidate.rlike(pattern)
    return F.when(allowed, F.lit(False)).otherwise(window_entropy(candidate, window) >= limit)


def secret_spans(text: Column) -> tuple[Column, Column]:
    """Spans of a text column, array<struct(start, rank, end, kind)>: of assign and access, and a struct of hex and random ones.

    Only texts that hold a pattern's trigger pay for its offsets. Start and end are code points, the end is exclusive;
    null counts as the empty text. The struct is null for a text without a long run.
    """
    text = F.coalesce(text.cast("string"), F.lit(""))
    none = F.expr(f"cast(array() as array<{_SPAN}>)")
    long_value = lambda match: F.length(F.regexp_extract(match, ASSIGN, 1)) >= 6
    hinted = lambda low: reduce(Column.__or__, [low.contains(h) for h in ASSIGN_HINTS])
    assign = F.when(_let(F.lower(text), hinted), _spans(text, ASSIGN, "assign", long_value)).otherwise(none)
    access = F.when(text.contains("AKIA"), _spans(text, ACCESS, "access")).otherwise(none)
    runs = F.when(F.concat(F.lit(" "), text).rlike(LONG_RUN), F.struct(_spans(text, HEX, "hex").alias("hex"), _spans(text, CANDIDATE, "entropy", is_random).alias("random")))
    return F.concat(assign, access), runs


def find_secrets(df: DataFrame, text_col: str = "text", out: str = "secret_spans") -> DataFrame:
    """Add `out`: every secret of each whole text, array<struct(start, rank, end, kind)>; one pass, no shuffle, no Python.

    An input column named `out` gives way. Repeated rows give repeated results; null and empty texts an empty array. An
    entropy span must lie apart from all pattern spans: in one sorted list it begins at or after the end of every pattern
    span before it, and ends at or before the start of the span that follows it.
    """
    named, runs = secret_spans(F.col(f"`{text_col}`"))
    kept = without(df, [out, "_named", "_runs"]).withColumns({"_named": named, "_runs": runs})
    is_base = lambda s: s["rank"] < KINDS.index("entropy")
    ends = lambda all_: _running(F.transform(all_, lambda s: F.when(is_base(s), s["end"]).otherwise(0)), lambda a, b: F.greatest(a, b))
    apart = lambda all_, before, s, i: is_base(s) | ((s["start"] >= F.get(before, i)) & (F.get(all_, i + 1).isNull() | (F.get(all_, i + 1)["start"] >= s["end"])))
    settled = lambda all_: _let(ends(all_), lambda before: F.filter(all_, lambda s, i: apart(all_, before, s, i)))
    merged = _let(F.array_sort(F.concat("_named", "_runs.hex", "_runs.random")), settled)
    return kept.withColumn(out, F.when(F.col("_runs").isNull(), F.array_sort("_named")).otherwise(merged)).drop("_named", "_runs")


def digest(found: DataFrame) -> DataFrame:
    """Counts per pattern, the hash of the pattern spans and all spans as text, from find_secrets's result."""
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("secret_spans", lambda s: s["kind"] != "entropy")
    of_kind = lambda k: F.size(F.filter("secret_spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    counts = [of_kind(k) for k in KINDS]
    return found.select("doc_id", *counts[:3], F.sha2(text(base), 256).alias("base_sha256"), text(F.col("secret_spans")).alias("spans"), counts[3])


_BLOCK = 1024


def _between(blocks: Column, start: Column, end: Column) -> Column:
    """The code points start to end of a text given in blocks of _BLOCK, from the blocks that hold them only."""
    low = F.shiftright(start, 10)
    held = F.array_join(F.slice(blocks, low + 1, F.greatest(F.lit(0), F.shiftright(end - 1, 10) - low + 1)), "")
    return F.when(end > start, F.substring(held, start - low * _BLOCK + 1, end - start)).otherwise("")


def redact(docs: DataFrame) -> DataFrame:
    """The same documents with each secret (overlapping ones as one) replaced by MARK, and n_chars brought up to date.

    A text with secrets is cut into blocks once, and what lies between the secrets is taken from them, so the work grows
    with the text, not with its length times the number of its secrets.
    """
    text = F.col("text")
    found = find_secrets(docs)

    def clean(blocks: Column, spans: Column, before: Column) -> Column:
        pieces = F.transform(spans, lambda s, i: F.when(s["start"] >= F.get(before, i), F.concat(_between(blocks, F.get(before, i), s["start"]), F.lit(MARK))).otherwise(""))
        return F.concat(F.array_join(pieces, ""), _between(blocks, F.element_at(before, -1), F.length(text)))

    ends = _running(F.transform("secret_spans", lambda s: s["end"]), lambda a, b: F.greatest(a, b))
    blocks = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{_BLOCK}}}"), F.lit(0))
    cleaned = _let(blocks, lambda own: _let(ends, lambda before: clean(own, F.col("secret_spans"), before)))
    redacted = found.withColumn("text", F.when(F.size("secret_spans") > 0, cleaned).otherwise(text))
    if "n_chars" in docs.columns:
        redacted = redacted.withColumn("n_chars", F.when(F.size("secret_spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return redacted.select(*[F.col(f"`{c}`") for c in docs.columns])
