"""Secrets in whole texts: fixed patterns and character Markov models.

Three fixed kinds are found by pattern.  A fourth, ``random``, is any long run
of token characters, or a stretch of one, whose log-likelihood under a Markov
chain of random strings exceeds that under a chain of ordinary identifiers and
words.  Both
chains are trained from labelled samples; their ratio is a table of whole
numbers, so a score is an exact sum.  All work is DataFrame expressions.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.llm.common import column, own_name

# The kinds' patterns, in the order in which ties are listed.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "random")
#: The same matches as dropping the short ones: only a maximal run can be long
#: enough, and the first AKIA of a run is the longest.
ACCESS_LONG, HEX_LONG = r"AKIA[A-Z0-9]{16,}", r"[0-9a-f]{24,}"
ASSIGN_LEAST = 6

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
LEAST_RUN = 20
RUN = r"[A-Za-z0-9+/_-]{20,}"
SCALE = 1000
#: A run is a secret above this much evidence in all and for each character.
LEAST_NATS, LEAST_EACH = 12.0, 0.35

_VERBS = "get set load save parse read write find make build update delete check open close send merge split count render".split()
_NOUNS = "user file index token cache session request response buffer config table column value handler manager factory service client message document".split()
_PROSE = (
    "internationalization responsibilities characteristically Datenverarbeitungsanlage Geschwindigkeitsbegrenzung anticonstitutionnellement "
    "responsabilidades desafortunadamente electroencephalogram institutionnellement Zusammenarbeit straightforwardness interoperability "
    "the and that with from this which would there their about these other words into could people first been over after "
    "der die und nicht werden eine einen auch nach wird durch noch wenn ueber les des que dans pour qui sur avec plus tout "
    "los las que por con para una del como pero sus este entre cuando desde sobre todo muy sin hasta hay donde quien"
).split()


def default_samples(seed: int = 11, each: int = 400) -> list[tuple[str, bool]]:
    """Labelled samples from a rule: (text, is random)."""
    rng = random.Random(seed)
    upper, lower, digits = ALPHABET[:26], ALPHABET[26:52], ALPHABET[52:62]
    out = [("".join(rng.choices(chars, k=rng.randint(20, 48))), True) for chars in (digits + "abcdef", upper + lower + digits, ALPHABET[:64], upper + digits, lower + digits) for _ in range(each)]
    for v in _VERBS:
        for n in _NOUNS:
            m = rng.choice(_NOUNS)
            out += [(f"{v}_{n}_{m}", False), (f"{v}{n.title()}{m.title()}", False), (f"{v.upper()}_{n.upper()}", False), (f"{m}-{n}-{rng.randint(1, 99)}", False), (f"{n}/{m}/{v}{rng.randint(0, 9)}", False)]
    return out + [(w, False) for w in _PROSE for _ in range(8)] + [(w.upper(), False) for w in _PROSE]


def train(samples: Iterable[tuple[str, bool]]) -> list[int]:
    """The ratio of the chains for each pair of characters, times SCALE.

    Each chain mixes the counted transition with the transition between kinds
    of characters (capital, small, digit, sign), uniform within the kind, so
    words of any spelling stay ordinary.
    """
    size = len(ALPHABET)
    code = {c: i for i, c in enumerate(ALPHABET)}
    kind = [0 if c.isupper() else 1 if c.islower() else 2 if c.isdigit() else 3 for c in ALPHABET]
    width = [kind.count(k) for k in range(4)]
    chains = []
    for want in (True, False):
        pair = [[0.0] * size for _ in range(size)]
        kinds = [[1.0] * 4 for _ in range(4)]
        for text, is_random in samples:
            if is_random == want:
                known = [code[c] for c in text if c in code]
                for a, b in zip(known, known[1:], strict=False):
                    pair[a][b] += 1
                    kinds[kind[a]][kind[b]] += 1
        chain = []
        for a in range(size):
            seen, all_kinds = sum(pair[a]), sum(kinds[kind[a]])
            for b in range(size):
                back = kinds[kind[a]][kind[b]] / all_kinds / width[kind[b]]
                chain.append((pair[a][b] + 60 * back) / (seen + 60))
        chains.append(chain)
    return [round(SCALE * math.log(r / o)) for r, o in zip(*chains, strict=True)]


def _cells(run: Column, table: Column) -> Column:
    """The ratio of each pair in a run of ALPHABET characters, times SCALE."""
    codes = F.transform(F.filter(F.split(run, ""), lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c))
    n = F.size(codes) - 1
    return F.zip_with(F.slice(codes, 1, n), F.slice(codes, 2, n), lambda a, b: F.element_at(table, ((a - 1) * len(ALPHABET) + b).cast("int")))


def score(run: Column, table: Column) -> Column:
    """The summed ratio of a run of ALPHABET characters, times SCALE."""
    return F.aggregate(_cells(run, table), F.lit(0).cast("long"), lambda s, x: s + x)


def stretches(run: Column, table: Column) -> Column:
    """Structs (from, to) of the secrets within a run, the end exclusive.

    A stretch gathers evidence beyond LEAST_EACH for each character and ends
    at its highest sum, once that falls to nothing or by LEAST_NATS.  It needs
    LEAST_NATS in all, and is widened to the signs around it.
    """
    least, each = int(LEAST_NATS * SCALE), int(LEAST_EACH * SCALE)
    made = lambda i, s, since, best, to, out: F.struct(i.alias("i"), s.alias("s"), since.alias("since"), best.alias("best"), to.alias("to"), out.alias("out"))
    whole, none = F.lit(0).cast("long"), F.array().cast("array<struct<from:int,to:int>>")

    def told(acc: Column) -> Column:
        enough = acc["best"] + each * (acc["to"] - acc["since"]) >= least
        return F.when(enough, F.array_append(acc["out"], F.struct(acc["since"].alias("from"), acc["to"].alias("to")))).otherwise(acc["out"])

    def step(acc: Column, x: Column) -> Column:
        s = acc["s"] + x - each
        more = made(acc["i"] + 1, s, acc["since"], F.greatest(acc["best"], s), F.when(s > acc["best"], acc["i"] + 2).otherwise(acc["to"]), acc["out"])
        return F.when((s <= 0) | (acc["best"] - s >= least), made(acc["i"] + 1, whole, acc["i"] + 1, whole, acc["i"] + 1, told(acc))).otherwise(more)

    found = F.aggregate(_cells(run, table), made(F.lit(0), whole, F.lit(0), whole, F.lit(0), none), step, told)
    before = lambda m: F.length(F.regexp_extract(F.reverse(F.substring(run, F.lit(1), m["from"])), r"^[A-Za-z0-9+]*", 0))
    after = lambda m: F.length(F.regexp_extract(F.substring(run, m["to"] + 1, F.length(run)), r"^[A-Za-z0-9+]*", 0))
    wide = F.transform(found, lambda m: F.struct((m["from"] - before(m)).alias("from"), (m["to"] + after(m)).alias("to")))
    return F.array_distinct(F.filter(wide, lambda m: m["to"] - m["from"] >= LEAST_RUN))


#: Texts are cut in pieces and arrays summed in blocks of so many, so that a text
#: with many spans costs no more for each.
BLOCK, SPREAD = 256, 16


def _let(value: Column, f) -> Column:
    """``f`` of a value that is made once, however often ``f`` names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _before(values: Column, zero: int, add, levels: int = 3) -> Column:
    """What ``add`` makes of all values before each, from ``zero`` on: by blocks, then within them."""
    fold = lambda part, start: F.aggregate(part, start, lambda s, v: add(s, v))
    if not levels:
        return F.transform(values, lambda v, i: fold(F.slice(values, F.lit(1), i), F.lit(zero)))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / SPREAD).cast("int")), lambda j: F.slice(values, j * SPREAD + 1, F.lit(SPREAD)))
    within = lambda b, s: F.transform(b, lambda v, i: fold(F.slice(b, F.lit(1), i), s))
    placed = lambda bs: _let(_before(F.transform(bs, lambda b: fold(b, F.lit(zero))), zero, add, levels - 1), lambda starts: F.flatten(F.zip_with(bs, starts, within)))
    return F.when(F.size(values) > 0, _let(blocks, placed)).otherwise(F.array().cast("array<int>"))


def _between(pieces: Column, a: Column, b: Column) -> Column:
    """The code points from a up to b of a text in pieces."""
    i, j = F.floor(a / BLOCK).cast("int"), F.floor(b / BLOCK).cast("int")
    piece = lambda k: F.coalesce(F.get(pieces, k), F.lit(""))
    inner = F.array_join(F.slice(pieces, i + 2, F.greatest(j - i - 1, F.lit(0))), "")
    apart = F.concat(F.substring(piece(i), (a % BLOCK + 1).cast("int"), F.lit(BLOCK)), inner, F.substring(piece(j), F.lit(1), (b % BLOCK).cast("int")))
    return F.when(b <= a, F.lit("")).when(i == j, F.substring(piece(i), (a % BLOCK + 1).cast("int"), (b - a).cast("int"))).otherwise(apart)


def _merged(spans: Column) -> Column:
    """Structs (start, end) of the joined spans, in their order; spans are sorted."""
    over = _let(F.transform(spans, lambda m: m["end"]), lambda ends: _before(ends, 0, lambda s, v: F.greatest(s, v)))
    each = F.zip_with(spans, over, lambda m, o: F.struct(m["start"].alias("start"), o.alias("over")))

    def told(first: Column) -> Column:
        ends = F.array_append(F.transform(F.slice(first, F.lit(2), F.size(first)), lambda m: m["over"]), F.array_max(F.transform(spans, lambda m: m["end"])))
        return F.zip_with(F.transform(first, lambda m: m["start"]), ends, lambda a, b: F.struct(a.alias("start"), b.alias("end")))

    return _let(F.filter(each, lambda m: m["start"] >= m["over"]), told)


def _parts(text: Column, spans: Column) -> tuple[Column, ...]:
    """What ``_replaced`` needs, empty where there is no span; a column of its own, so it is made once."""
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    return F.when(F.size(spans) > 0, pieces).alias("pieces"), F.when(F.size(spans) > 0, _merged(F.sort_array(spans))).alias("merged"), F.length(text).alias("length")


def _replaced(parts: Column, mark) -> Column:
    """The text with ``mark`` of each joined span in its place."""
    pieces, merged = parts["pieces"], parts["merged"]
    gaps = F.zip_with(F.concat(F.array(F.lit(0)), F.transform(merged, lambda m: m["end"])), F.concat(F.transform(merged, lambda m: m["start"]), F.array(parts["length"])), lambda a, b: _between(pieces, a, b))
    marks = F.array_append(F.transform(merged, mark), F.lit(""))
    return F.array_join(F.zip_with(gaps, marks, lambda g, m: F.concat(g, m)), "")


def _starts(text: Column, pattern: str, found: Column) -> Column:
    """Code point starts of the matches, from the gaps that split leaves."""
    gaps = F.transform(F.slice(F.split(text, pattern, -1), 1, F.size(found)), lambda gap: F.length(gap))
    before = lambda steps: _let(F.transform(steps, lambda x: x["gap"] + x["len"]), lambda n: _before(n, 0, lambda s, v: s + v))
    steps = F.zip_with(gaps, found, lambda gap, m: F.struct(gap.alias("gap"), F.length(m).alias("len")))
    return _let(steps, lambda steps: F.zip_with(before(steps), steps, lambda b, x: b + x["gap"]))


def _spans(text: Column, kind: int, pattern: str, value: int) -> Column:
    """Structs (start, kind, end, value) of the matches of one pattern."""
    empty = F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")

    def placed(found: Column) -> Column:
        values = F.regexp_extract_all(text, F.lit(pattern), F.lit(value)) if value else found
        whole = F.arrays_zip(_starts(text, pattern, found).alias("s"), F.transform(found, lambda m: F.length(m)).alias("n"), values.alias("v"))
        out = F.transform(whole, lambda x: F.struct(x["s"].alias("start"), F.lit(kind).alias("kind"), (x["s"] + x["n"]).alias("end"), x["v"].alias("value")))
        return F.when(F.size(found) > 0, out).otherwise(empty)

    return _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def find_secrets(docs: DataFrame, text_col: str = "text", into: str = "secrets", *, samples: Iterable[tuple[str, bool]] | None = None) -> DataFrame:
    """All columns of ``docs`` and an array of (start, kind, end) structs.

    ``kind`` indexes KINDS; starts and ends are code points, the end exclusive.
    Fixed spans are leftmost and non-overlapping within their kind and stay
    whatever the models say.  What they leave of a run is a run of its own; a
    run is a random span as a whole, or the stretches in it are.  Random spans
    never overlap fixed ones.  Null and empty texts have none; every row is
    scanned whole, repeated rows each.
    """
    stage = own_name(docs, "__stage")
    table = F.split(F.lit(",".join(map(str, train(list(samples or default_samples()))))), ",").cast("array<int>")
    text = F.coalesce(column(docs, text_col).cast("string"), F.lit(""))
    out = docs.withColumn(stage, F.struct(text.alias("t"), _spans(text, 0, ASSIGN, 2).alias("a"), _spans(text, 1, ACCESS_LONG, 0).alias("b"), _spans(text, 2, HEX_LONG, 0).alias("c")))
    x = F.col(stage)
    fixed = F.concat(F.filter(x["a"], lambda m: F.length(m["value"]) >= ASSIGN_LEAST), x["b"], x["c"])
    bare = lambda spans: F.transform(spans, lambda m: F.struct(m["start"], m["kind"], m["end"]))
    out = out.withColumn(stage, F.struct(bare(fixed).alias("fixed"), x["t"].alias("t")))
    out = out.withColumn(stage, F.struct(x["fixed"].alias("fixed"), x["t"].alias("t"), *_parts(x["t"], x["fixed"])))
    blanked = _replaced(x, lambda m: F.repeat(F.lit(" "), m["end"] - m["start"]))
    out = out.withColumn(stage, F.struct(x["fixed"].alias("fixed"), F.when(F.size(x["fixed"]) > 0, blanked).otherwise(x["t"]).alias("t")))
    out = out.withColumn(stage, F.struct(x["fixed"].alias("fixed"), _spans(x["t"], 3, RUN, 0).alias("runs")))
    is_random = lambda run: score(run["value"], table) >= F.greatest(F.lit(int(LEAST_NATS * SCALE)), F.length(run["value"]) * int(LEAST_EACH * SCALE))
    inner = lambda m: F.transform(stretches(m["value"], table), lambda p: F.struct((m["start"] + p["from"]).alias("start"), m["kind"], (m["start"] + p["to"]).alias("end")))
    found = F.flatten(F.transform(x["runs"], lambda m: F.when(is_random(m), F.array(F.struct(m["start"], m["kind"], m["end"]))).otherwise(inner(m))))
    spans = F.sort_array(F.concat(x["fixed"], found))
    return out.withColumn(stage, spans).withColumnRenamed(stage, into)


def joined(spans: Column) -> Column:
    """kind:start:end of the spans, comma-joined in their order."""
    name = lambda m: F.element_at(F.array(*map(F.lit, KINDS)), m["kind"] + 1)
    return F.array_join(F.transform(spans, lambda m: F.concat_ws(":", name(m), m["start"].cast("string"), m["end"].cast("string"))), ",")


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts by fixed kind, the fixed spans' SHA-256 and all spans of each row."""
    rows = docs.select(column(docs, id_col).alias("id"), column(docs, text_col).alias("text"))
    found = find_secrets(rows, "text").select("id", "secrets")
    s = F.col("secrets")
    fixed = F.filter(s, lambda m: m["kind"] < 3)
    count = lambda k: F.size(F.filter(s, lambda m: m["kind"] == k)).cast("long")
    return found.select(
        F.col("id").alias(id_col), count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(joined(fixed), 256).alias("base_sha256"), joined(s).alias("spans"),
    )


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of its texts replaced; other texts unchanged.

    Overlapping spans are one.  Columns, rows and nulls stay as they are.
    """
    name = own_name(docs, "__secrets")
    found = find_secrets(docs, text_col, name)
    text = column(found, text_col)
    found = found.withColumn(name, F.struct(*_parts(text, F.col(name))))
    new = F.when(F.col(name)["merged"].isNotNull(), _replaced(F.col(name), lambda m: F.lit(mark))).otherwise(text)
    return found.withColumn(text_col, new).drop(name)
