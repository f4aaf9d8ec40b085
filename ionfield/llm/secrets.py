"""Secret scans with DataFrame and SQL functions only: fixed patterns, and a randomness test battery.

Base spans come from three patterns, per kind leftmost and non-overlapping; positions are code points and
follow from the lengths of the pieces between matches.  The method adds spans of kind ``random``: runs of
encoded-looking characters outside base spans, 16 or more.  For each run the smallest alphabet that holds it is
taken as its encoding (runs of digits alone are numbers and not tested), and three tests are made under uniform
randomness: chi-squared over the alphabet, runs above and below the alphabet's middle, and serial correlation of
neighbours.  Their p-values combine to Fisher's statistic; a small one means random.

Which statistics are small enough depends on the alphabet and the length: short strings of ordinary text pass such
tests too.  So the same statistic is taken of ordinary text, for each alphabet and length class that has a candidate
(no result depends on the others).  Every whole text, without its encoded-looking runs, is written in that alphabet
(case folded, other characters left out), and all its consecutive strings of the class's length are null strings;
what is left at the end is shorter than that.  A fixed page of prose adds windows for every alphabet and class, so the
rule is the same for a table of one document.  A candidate's p-value is the larger of two: the share of null strings with a statistic as small, and the
lower tail of a normal distribution with the mean and variance of the null strings' cube roots (a sum of chi-squared
terms has a nearly normal cube root), which reaches below one in the number of null strings.  The
Benjamini-Hochberg step over the candidates of all alphabets and classes controls the false discoveries at
``ALPHA``; so whether a run is flagged depends on the table's other candidates, as the procedure has it.
Statistics are binned (bins of 1/4, rounded up), so the histograms have a bounded number of rows, and only one
threshold per alphabet and class reaches the driver.  The texts are read three times: for the candidates, for the
null strings of their alphabets and classes, and to apply the thresholds.

Defined results: null text counts as empty (no spans, the digest of the empty string); null ids and repeated
rows are kept, and their null strings and candidates count each time; an empty table gives an empty result; other
columns are ignored, or kept by ``redact``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize

KINDS = ("assign", "access", "hex", "random")
# Classes of several ranges are listed in full where all text is read: java.util.regex finds a listed character in a
# table, but asks one range after the other through calls that are not inlined.
LETTERS_AND_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
# Patterns of the base kinds: fixed values (pattern, group whose length counts, least length).
PATTERNS = (
    (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    (r"AKIA[A-Z0-9]+", 0, 20),
    (r"[0123456789abcdef]{24,}", 0, 24),  # runs are maximal, so shorter ones need no match that is then dropped
)
LEAST_RUN = 16
CANDIDATE = rf"[{LETTERS_AND_DIGITS}+/_-]{{16,}}={{0,2}}"
# Alphabets by size: fixed values (pattern, symbols).
ALPHABETS = (
    ("^[0-9]+$", "0123456789"),
    ("^[0-9a-f]+$", "0123456789abcdef"),
    ("^[0-9A-F]+$", "0123456789ABCDEF"),
    ("^[a-z]+$", "abcdefghijklmnopqrstuvwxyz"),
    ("^[A-Z]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("^[0-9a-z]+$", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("^[0-9A-Z]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("^[0-9A-Za-z]+$", LETTERS_AND_DIGITS),
    ("^.*$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/"),
)
#: How a text is written in each alphabet but the first: case, and what is left out.
FOLDS = (("lower", "[^0-9a-f]"), ("upper", "[^0-9A-F]"), ("lower", "[^a-z]"), ("upper", "[^A-Z]"), ("upper", "[^A-Z2-7]"), ("lower", "[^0-9a-z]"), ("upper", "[^0-9A-Z]"), ("initcap", "[^0-9A-Za-z]"), ("initcap", "[^0-9A-Za-z+/]"))
SPARSE = ("[^0-9a-f]", "[^0-9A-F]")
#: Length classes: least length, and the length of the class's null strings.
CLASSES = ((16, 17), (20, 21), (24, 27), (32, 38), (48, 60), (80, 100))
#: Characters of a window of the prose: enough for 100 in any alphabet, as a rule.
WINDOW = 640
# Ordinary prose, numbers, names and paths: a fixed value.
PROSE = (
    "The harbour office opened at half past seven on Monday, 14 March 2016, and by noon some 230 people had come to ask about the new ferry. "
    "Most of them wanted to know what a return ticket would cost; a few had read the notice in the evening paper and brought it along. "
    "The clerk, who had worked there since 1987, kept the older records in a cupboard under the stairs and the recent ones on a shared disk, "
    "in folders such as /srv/office/reports/summer or /home/guest/documents/letters. Every form carries a number between 10250 and 98431, "
    "a date, the name of the ship and the weight of the cargo in kilograms. When a form is lost, which happens about four times a year, "
    "someone has to walk down to the quay and ask the captain for a copy. Nobody likes that job in winter, when the wind comes from the north "
    "and the boards are covered with ice. In 2009 the council bought a program whose functions have names like getCustomerAccount, "
    "updateShippingAddress and printMonthlyOverview2; it still runs, though the company that wrote it closed long ago. A student from the "
    "technical school added a page where visitors can choose a language, look up arrivals and departures, and leave a message for the staff. "
    "Messages are answered within 3 days, except in August. Last year there were 1624 of them: 911 about prices, 408 about lost luggage, "
    "and the rest about everything else, from the colour of the lifeboats to the best place to watch birds. One writer asked whether dogs may "
    "travel on deck (they may, for 5 euros), another whether the bakery beside the lighthouse would open again. The clerk replied to each, "
    "usually before lunch, and filed a printed copy under the first letter of the sender's family name."
)
ALPHA = 0.05
BINS_PER_UNIT = 4
_SPANS = "array<struct<start:int,kind:int,stop:int>>"


def _located(text: str, pattern: str, group: int, least: int, kind: int) -> Column:
    """Spans of the pattern's matches whose group has ``least`` characters, in column ``text``."""
    quoted = pattern.replace("\\", "\\\\").replace("'", "\\'")
    found = f"regexp_extract_all({text}, '{quoted}', 0)"
    parts = f"regexp_extract_all({text}, '{quoted}', {group})"
    return F.expr(f"""
      transform(array({found}), w -> if(size(w) = 0, cast(array() as {_SPANS}),
        aggregate(
          zip_with(zip_with(slice(split({text}, '{quoted}', -1), 1, size(w)), w, (g, m) -> named_struct('g', g, 'm', m)), {parts if group else "w"}, (y, p) -> named_struct('g', y.g, 'm', y.m, 'p', p)),
          named_struct('pos', 0, 'spans', cast(array() as {_SPANS})),
          (a, x) -> named_struct(
            'pos', a.pos + char_length(x.g) + char_length(x.m),
            'spans', if(char_length(x.p) >= {least},
               concat(a.spans, cast(array(named_struct('start', a.pos + char_length(x.g), 'kind', {kind}, 'stop', a.pos + char_length(x.g) + char_length(x.m))) as {_SPANS})),
               a.spans)),
          a -> a.spans)))[0]""")


def with_base_spans(docs: DataFrame) -> DataFrame:
    """Adds ``base``: the base kinds' spans, by start and then kind."""
    docs = docs.withColumn("body", F.coalesce("text", F.lit("")))
    kinds = [_located("body", p, g, n, k) for k, (p, g, n) in enumerate(PATTERNS)]
    return docs.withColumn("base", F.array_sort(F.concat(*kinds)))


def _upper_tail(z: str) -> str:
    """P(N > z) by a rational approximation of erfc with absolute error below 1e-7, at least 1e-7."""
    t = f"(1 / (1 + 0.3275911 * abs({z}) / sqrt(2D)))"
    tail = f"(0.5 * {t} * (0.254829592 + {t} * (-0.284496736 + {t} * (1.421413741 + {t} * (-1.453152027 + {t} * 1.061405429)))) * exp(-{z} * {z} / 2))"
    return f"greatest(if({z} >= 0, {tail}, 1 - {tail}), 1e-7D)"


def _inferred(v: str) -> str:
    """SQL: number of the smallest alphabet that holds string ``v``."""
    coded = f"translate(rtrim('=', {v}), '-_', '+/')"
    return "case " + " ".join(f"when {coded} rlike '{p}' then {i}" for i, (p, _) in enumerate(ALPHABETS)) + " end"


def _statistics(items: str) -> str:
    """SQL: for an array of structs (v: string, a: number of its alphabet), structs (w, a, bin, cls): the string,
    the alphabet, the binned Fisher statistic and the length class."""
    alphabets = "array(" + ", ".join(f"'{a}'" for _, a in ALPHABETS) + ")"
    least = [c[0] for c in CLASSES]
    cls = "case " + " ".join(f"when c.n >= {n} then {i}" for i, n in reversed(list(enumerate(least)))) + " else -1 end"
    coded = f"""transform({items}, i -> named_struct('v', i.v, 'i', i.a, 'w', translate(rtrim('=', i.v), '-_', '+/'), 'a', element_at({alphabets}, i.a + 1)))"""
    codes = f"""transform({coded}, c -> named_struct('v', c.v, 'i', c.i, 'n', length(c.w), 'k', length(c.a),
        'x', transform(split(c.w, ''), s -> cast(instr(c.a, s) - 1 as double)),
        'sq', aggregate(split(c.a, ''), 0D, (t, s) -> t + pow(length(c.w) - length(replace(c.w, s, '')), 2))))"""
    moments = f"""transform({codes}, c -> named_struct('v', c.v, 'i', c.i, 'n', c.n, 'k', c.k, 'sq', c.sq, 'x', c.x,
        'm', aggregate(c.x, 0D, (t, s) -> t + s) / greatest(c.n, 1),
        'low', aggregate(c.x, 0D, (t, s) -> t + if(s < c.k / 2, 1D, 0D)),
        'runs', 1 + aggregate(zip_with(slice(c.x, 1, greatest(c.n - 1, 0)), slice(c.x, 2, greatest(c.n - 1, 0)), (p, q) -> if((p < c.k / 2) = (q < c.k / 2), 0D, 1D)), 0D, (t, s) -> t + s)))"""
    sums = f"""transform({moments}, c -> named_struct('v', c.v, 'i', c.i, 'n', c.n, 'k', c.k, 'sq', c.sq, 'low', c.low, 'high', c.n - c.low, 'runs', c.runs,
        'var', aggregate(c.x, 0D, (t, s) -> t + (s - c.m) * (s - c.m)),
        'cov', aggregate(zip_with(slice(c.x, 1, greatest(c.n - 1, 0)), slice(c.x, 2, greatest(c.n - 1, 0)), (p, q) -> (p - c.m) * (q - c.m)), 0D, (t, s) -> t + s)))"""
    # Wilson-Hilferty for chi-squared; both other tests are two-sided.
    scores = f"""transform({sums}, c -> named_struct('v', c.v, 'i', c.i, 'n', c.n,
        'z1', (pow(greatest(c.sq * c.k / greatest(c.n, 1) - c.n, 0D) / (c.k - 1), 1D / 3) - (1 - 2D / (9 * (c.k - 1)))) / sqrt(2D / (9 * (c.k - 1))),
        'z2', if(c.low * c.high < 1 or c.n < 3, 9D, abs(c.runs - 1 - 2 * c.low * c.high / c.n) / sqrt(greatest(2 * c.low * c.high * (2 * c.low * c.high - c.n) / (c.n * c.n * (c.n - 1D)), 1e-3D))),
        'z3', if(c.var <= 0, 9D, abs(c.cov / c.var + 1D / greatest(c.n, 1)) * sqrt(c.n))))"""
    p1, p2, p3 = _upper_tail("c.z1"), _upper_tail("c.z2"), _upper_tail("c.z3")
    return f"""transform({scores}, c -> named_struct('w', c.v, 'a', c.i, 'bin', cast(ceil(-2 * {BINS_PER_UNIT} * (ln({p1}) + ln(least(2 * {p2}, 1D)) + ln(least(2 * {p3}, 1D)))) as int), 'cls', {cls}))"""


def _candidates() -> Column:
    """Candidate spans of ``body``, those that overlap base spans left out."""
    spans = _located("body", CANDIDATE, 0, LEAST_RUN, 3)
    return F.filter(spans, lambda s: ~F.exists("base", lambda b: (b["start"] < s["stop"]) & (s["start"] < b["stop"])))


def _with_candidates(docs: DataFrame) -> DataFrame:
    """Adds the candidate spans ``found`` and their statistics ``tested``; class -1 is not tested."""
    found = with_base_spans(docs).withColumn("found", _candidates())
    strings = f"transform(transform(found, f -> substring(body, f.start + 1, f.stop - f.start)), v -> named_struct('v', v, 'a', {_inferred('v')}))"
    tested = f"transform({_statistics(strings)}, t -> named_struct('a', t.a, 'bin', t.bin, 'cls', if(t.a = 0, -1, t.cls)))"
    return found.withColumn("tested", F.expr(tested))


def _written(windows: str) -> str:
    """SQL: for an array of structs (t: text, a: alphabet, c: class), structs (v, a) of the null strings long enough."""
    dense = "substring(i.t, 1, 200)"  # more than any class needs where most characters stay
    cased = lambda case, out: f"replace(initcap({dense}), ' ', '/')" if "/" in out else f"{case}({'i.t' if out in SPARSE else dense})"
    folded = "case i.a " + " ".join(f"when {a} then regexp_replace({cased(case, out)}, '{out}', '')" for a, (case, out) in enumerate(FOLDS, 1)) + " end"
    length = "element_at(array(" + ", ".join(str(n) for _, n in CLASSES) + "), i.c + 1)"
    return f"filter(transform({windows}, i -> named_struct('v', substring({folded}, 1, {length}), 'a', i.a, 'n', {length})), i -> char_length(i.v) = i.n)"


def _windows_of_prose() -> str:
    """SQL: windows of variable ``pieces`` (one text) at every 16th character, for every alphabet and class."""
    return f"flatten(transform(sequence(0, char_length(pieces) - {WINDOW}, 16), s -> flatten(transform(sequence(1, {len(FOLDS)}), a -> transform(sequence(0, {len(CLASSES) - 1}), c -> named_struct('t', substring(pieces, 1 + s, {WINDOW}), 'a', a, 'c', c))))))"


#: Alphabets in capitals, by those in small letters that have the same codes; and what an alphabet's number is raised by
#: where its strings count for both.
CAPITALS = {1: 2, 3: 4, 6: 7}
BOTH = 16
#: Eight bytes of 1.
_ONES = 0x0101010101010101


def _cell(a: int, c: int) -> Column:
    """What the null strings of alphabet ``a`` and class ``c`` have in common.

    A byte's code is itself less ``base``, less ``alpha`` for letters, less ``small`` for small ones.  Character 8 j + i
    of a string is bit 8 (7 - i) + j of a plane's first word, beyond 64 characters of its second; ``all`` marks the
    string's characters there, ``last`` its last one.
    """
    symbols, n = ALPHABETS[a % BOTH][1], CLASSES[c][1]
    base = ord("2") - 26 if symbols.startswith("A") and symbols.endswith("7") else ord("0")
    alpha = next(ord(s) - symbols.index(s) for s in symbols if s.isalpha()) - base
    small = ord("a") - symbols.index("a") - base - alpha if "a" in symbols else 0
    bits = [(t // 64, 1 << (8 * (7 - t % 8) + t // 8 % 8)) for t in range(n)]
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    masks = {f"all{w}": signed(sum(b for word, b in bits if word == w)) for w in (0, 1)} | {f"last{w}": signed(bits[-1][1] if bits[-1][0] == w else 0) for w in (0, 1)}
    longs = {"base": base * _ONES, "alpha": alpha, "small": small, "upper": (64 - len(symbols) // 2) * _ONES} | masks
    ints = {"a": a, "cls": c, "words": -(-n // 8)}
    doubles = {"n": n, "k": len(symbols)}
    typed = [F.lit(v).cast(t).alias(name) for t, values in (("int", ints), ("long", longs), ("double", doubles)) for name, v in values.items()]
    return F.struct(*typed, F.lit(symbols[0]).alias("pad"))


def _null_strings(docs: DataFrame, cells: list[tuple[int, int]]) -> DataFrame:
    """(i, w): all null strings of the texts for the alphabet and class that are number i, from 0, of ``cells``.

    A cell with ``BOTH`` gets the strings that small letters and capitals would both get, from the texts whose other
    characters give no letter in either case (as the sharp s does); the two cells then get those of the other texts.
    """
    cased = {"lower": F.lower("body"), "upper": F.upper("body"), "initcap": F.initcap("body")}

    def folded(a: int) -> Column:
        case, symbols = FOLDS[a - 1][0], ALPHABETS[a][1]
        out = f"[^{symbols}]+"  # runs of what the fold leaves out
        if "/" not in symbols:
            return F.regexp_replace(cased[case], out, "")
        # Both signs get the bytes behind z, where their codes are.
        return F.translate(F.regexp_replace(F.replace(cased[case], F.lit(" "), F.lit("/")), out, ""), "+/", "{|")

    shared = {(x, c) for a, c in cells if a >= BOTH for x in (a - BOTH, CAPITALS[a - BOTH])}

    def classes(a: int, plain: bool) -> Column:
        found = [(i, c) for i, (b, c) in enumerate(cells) if (b == a and not (plain and (a, c) in shared)) or (plain and b == a + BOTH)]
        none = F.array().cast("array<struct<i:int,pattern:string>>")
        return F.array(*(F.struct(F.lit(i).alias("i"), F.lit(f".{{{CLASSES[c][1]}}}").alias("pattern")) for i, c in found)) if found else none

    def strings(a: int) -> Column:
        if not any((a, c) in shared for _, c in cells):
            return F.struct(folded(a).alias("v"), classes(a, False).alias("cs"))
        written = folded(a) if any(b == a + BOTH or (b == a and (a, c) not in shared) for b, c in cells) else F.when(~F.col("plain"), folded(a))
        return F.struct(written.alias("v"), F.when(F.col("plain"), classes(a, True)).otherwise(classes(a, False)).alias("cs"))

    # One alphabet, class and array of strings at a time; explode_outer, before which the optimizer puts no filter on
    # the whole expression.
    rows = docs.select(F.regexp_replace(F.coalesce("text", F.lit("")), CANDIDATE, " ").alias("body"))
    if shared:
        rows = rows.select("body", F.regexp_replace("body", r"[\x00-\x7F]+", "").alias("other"))
        rows = rows.select("body", (~F.concat(F.lower("other"), F.upper("other")).rlike("[A-Za-z]")).alias("plain"))
    rows = rows.select(F.explode_outer(F.array(*map(strings, sorted({a for a, _ in cells if a < BOTH})))).alias("f"))
    rows = rows.select("f.v", F.explode_outer("f.cs").alias("c")).select("v", "c.i", "c.pattern")
    return rows.select("i", F.explode_outer(F.regexp_extract_all("v", F.col("pattern"), F.lit(0))).alias("w")).where("w is not null")


def _null_statistics(strings: DataFrame, cells: list[tuple[int, int]]) -> DataFrame:
    """(a, cls, bin) of null strings (i, w) of ``cells``: the result of ``_statistics`` from bit planes, as all texts are many strings."""
    # What no cell's strings are long enough for, and symbols that none has, would only give zeros.
    words = -(-max(CLASSES[c][1] for _, c in cells) // 8)
    least = -(-min(CLASSES[c][1] for _, c in cells) // 8)
    halves = range(-(-words // 8))
    symbols = max(len(ALPHABETS[a % BOTH][1]) for a, _ in cells)
    bits = range((symbols - 1).bit_length())
    have = lambda j, e: e if j < least else f"if(words > {j}, {e}, 0L)"
    total = lambda terms: "(" + " + ".join(terms) + ")"
    # A lambda keeps a projection out of whole-stage code, whose single method would be too long to be compiled; the
    # projection's own code is split, and what its expressions share is evaluated once.
    apart = "aggregate(array(a), 0, (s, x) -> x) as a"
    constants = ("cls", "n", "k", "all0", "all1", "last0", "last1")

    byte = lambda j: have(j, f"coalesce(cast(conv(substring(h, {16 * j + 1}, 16), 16, 10) as long), 0L)")
    letters = lambda j: f"alpha * (shiftright({byte(j)}, 6) & {_ONES}L) + small * (shiftright({byte(j)}, 6) & shiftright({byte(j)}, 5) & {_ONES}L)"
    code = [f"({byte(j)} - {have(j, 'base')} - ({letters(j)}))" for j in range(words)]
    bit = lambda p, j: f"shiftright({code[j]} + upper, 6)" if p == "u" else f"shiftright({code[j]}, {p})"
    plane = lambda p, w: " | ".join(f"shiftleft({bit(p, j)} & {_ONES}L, {j % 8})" for j in range(8 * w, min(8 * w + 8, words)))
    strings = strings.select(F.get(F.array(*(_cell(a, c) for a, c in cells)), F.col("i")).alias("c"), "w")
    rows = strings.select("c.*", F.expr("hex(rpad(w, 8 * c.words, c.pad))").alias("h"))
    # A code's planes are its bits, and whether it is in the alphabet's upper half.  Nothing is null; coalesce lets the
    # optimizer know, which shortens the code of what follows.
    rows = rows.selectExpr(apart, *(f"coalesce({c}, 0) as {c}" for c in constants), *(f"coalesce({plane(p, w)}, 0L) as p{p}_{w}" for p in (*bits, "u") for w in halves))

    # ``w`` is the number of the plane's word; ``after`` is a plane one character on.
    count = lambda e: "cast(" + " + ".join(f"bit_count({e(w)})" for w in halves) + " as double)"
    after = lambda p, w: f"(shiftleft(p{p}_{w}, 8) | shiftrightunsigned(p{p}_{w}, 57)" + ("" if w or len(halves) == 1 else f" | shiftleft(shiftrightunsigned(p{p}_1, 56) & 1L, 7)") + ")"
    eighth = lambda v, low, w: "(" + " & ".join(f"{'' if v >> b & 1 else '~'}p{low + b}_{w}" for b in range(3) if low + b in bits) + (f" & all{w})" if low else ")")
    symbol = [count(lambda w: f"{eighth(v >> 3, 3, w)} & {eighth(v & 7, 0, w)}") for v in range(symbols)]  # noqa: B023
    rows = rows.selectExpr(
        apart, "cls", "n", "k",
        total([f"{c} * {c}" for c in symbol]) + " as sq",
        total([f"{1 << b} * " + count(lambda w: f"p{b}_{w}") for b in bits]) + " as sx",  # noqa: B023
        total([f"{1 << b} * cast(shiftrightunsigned(p{b}_0, 56) & 1L as double)" for b in bits]) + " as first",
        total([f"{1 << b} * " + count(lambda w: f"p{b}_{w} & last{w}") for b in bits]) + " as final",  # noqa: B023
        total([f"{(1 << b + c) * (1 if b == c else 2)} * " + count(lambda w: f"p{b}_{w} & p{c}_{w}") for b in bits for c in bits if b <= c]) + " as sxx",  # noqa: B023
        total([f"{1 << b + c} * " + count(lambda w: f"p{b}_{w} & {after(c, w)}") for b in bits for c in bits]) + " as sxy",  # noqa: B023
        count(lambda w: f"pu_{w}") + " as high",
        count(lambda w: f"(pu_{w} ^ {after('u', w)}) & all{w} & ~last{w}") + " as changes",
    )
    rows = rows.selectExpr("a", "cls", "n", "k", "sq", "high * (n - high) as lh", "changes", "n * sxx - sx * sx as var", "n * sxy - sx * (2 * sx - first - final) + (n - 1) / n * sx * sx as cov")
    rows = rows.selectExpr(
        "a", "cls",
        "(pow(greatest(sq * k / n - n, 0D) / (k - 1), 1D / 3) - (1 - 2D / (9 * (k - 1)))) / sqrt(2D / (9 * (k - 1))) as z1",
        "if(lh < 1, 9D, abs(changes - 2 * lh / n) / sqrt(greatest(2 * lh * (2 * lh - n) / (n * n * (n - 1)), 1e-3D))) as z2",
        "if(var <= 0, 9D, abs(cov / var + 1 / n) * sqrt(n)) as z3",
    )
    return rows.selectExpr("a", "cls", f"cast(ceil(-2 * {BINS_PER_UNIT} * (ln({_upper_tail('z1')}) + ln(least(2 * {_upper_tail('z2')}, 1D)) + ln(least(2 * {_upper_tail('z3')}, 1D)))) as int) as bin")


def histogram(docs: DataFrame) -> DataFrame:
    """(a, cls, bin, n, n_null): candidates and null strings per alphabet, length class and binned statistic."""
    tested = _with_candidates(docs.select("text")).select(F.explode_outer("tested").alias("t")).select("t.*").where("cls >= 0")
    # Some hundred rows for each alphabet and class.
    found = materialize(tested.groupBy("a", "cls", "bin").agg(F.count(F.lit(1)).alias("n")), "candidates")
    cells = sorted((r["a"], r["cls"]) for r in found.select("a", "cls").distinct().collect())
    # A lambda's variable holds the prose, as a column's expression would be evaluated at each use.
    prose = "'" + PROSE.replace("'", "\\'") + "'"
    of_prose = docs.sparkSession.range(1).select(F.explode_outer(F.expr(f"flatten(transform(array({prose}), pieces -> {_statistics(_written(_windows_of_prose()))}))")).alias("t"))
    nulls = of_prose.select("t.a", "t.cls", "t.bin")
    if cells:
        cells += [(BOTH + a, c) for a, c in cells if (CAPITALS.get(a), c) in cells]
        nulls = nulls.unionByName(_null_statistics(_null_strings(docs, cells), cells))
    nulls = nulls.groupBy("a", "cls", "bin").agg(F.count(F.lit(1)).alias("n_null"))
    capitals = "case a " + " ".join(f"when {BOTH + a} then {b}" for a, b in CAPITALS.items()) + " end"
    nulls = nulls.withColumn("a", F.explode_outer(F.expr(f"if(a < {BOTH}, array(a), array(a - {BOTH}, {capitals}))")))
    both = found.unionByName(nulls, allowMissingColumns=True)
    return both.groupBy("a", "cls", "bin").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("n_null"), F.lit(0)).alias("n_null"))


def with_p_values(table: DataFrame) -> DataFrame:
    """Adds ``p`` to a histogram: of the bin's candidates, under the null strings of their alphabet and class."""
    of = Window.partitionBy("a", "cls")
    x = F.cbrt(F.greatest(F.col("bin"), F.lit(0)) / float(BINS_PER_UNIT))
    total = F.sum("n_null").over(of)
    mean = F.sum(F.col("n_null") * x).over(of) / total
    square = F.sum(F.col("n_null") * x * x).over(of) / total
    z = (mean - x) / F.sqrt(F.greatest(square - mean * mean, F.lit(0.01)))
    table = table.withColumn("z", z).withColumn("share", F.sum("n_null").over(of.orderBy("bin")) / (1 + total))
    return table.withColumn("p", F.when(F.col("z").isNull(), 1.0).otherwise(F.greatest("share", F.expr(_upper_tail("z"))))).drop("z", "share")


def thresholds(docs: DataFrame, alpha: float = ALPHA) -> dict[tuple[int, int], int]:
    """Largest flagged bin of each alphabet and length class."""
    # The windows without a key are over the bounded histogram: some hundred bins for each alphabet and class.
    ranked = with_p_values(histogram(docs)).where("n > 0").withColumn("k", F.sum("n").over(Window.orderBy("p").rangeBetween(Window.unboundedPreceding, 0))).withColumn("m", F.sum("n").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    last = ranked.where(F.col("p") <= F.lit(alpha) * F.col("k") / F.col("m")).agg(F.max("p").alias("last"))
    flagged = ranked.crossJoin(F.broadcast(last)).where("p <= last").groupBy("a", "cls").agg(F.max("bin").alias("bin"))  # one row
    return {(r["a"], r["cls"]): r["bin"] for r in flagged.collect()}


def _spans_of(docs: DataFrame, alpha: float) -> DataFrame:
    """Adds ``base`` and ``spans`` (base and random spans, by start and then kind)."""
    limits = thresholds(docs, alpha)
    rows = _with_candidates(docs)
    flagged = " or ".join(f"(t.a = {a} and t.cls = {c} and t.bin <= {b})" for (a, c), b in sorted(limits.items())) or "false"
    random = F.expr(f"transform(filter(arrays_zip(found, tested), z -> exists(array(z.tested), t -> {flagged})), z -> z.found)")
    return rows.withColumn("spans", F.array_sort(F.concat("base", random)))


def _joined(spans: str) -> Column:
    name = "element_at(array(" + ", ".join(f"'{k}'" for k in KINDS) + "), s.kind + 1)"
    return F.expr(f"array_join(transform({spans}, s -> concat({name}, ':', s.start, ':', s.stop)), ',')")


def scan(docs: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans) of every row of docs."""
    rows = _spans_of(docs.select("doc_id", "text"), alpha)
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return rows.select("doc_id", *(count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)), F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"))


def redact(docs: DataFrame, mark: str = "[SECRET]", alpha: float = ALPHA) -> DataFrame:
    """docs with every span (overlapping ones as one) replaced by ``mark``; n_chars, if there, is recounted."""
    names = docs.columns
    rows = _spans_of(docs.select(F.struct(*names).alias("row"), "text"), alpha)
    clean = F.expr(f"""aggregate(spans, named_struct('at', 0, 'out', ''),
        (a, s) -> if(s.start < a.at, named_struct('at', greatest(a.at, s.stop), 'out', a.out),
            named_struct('at', s.stop, 'out', concat(a.out, substring(body, a.at + 1, s.start - a.at), '{mark}'))),
        a -> concat(a.out, substring(body, a.at + 1)))""")
    text = F.when(F.size("spans") > 0, clean).otherwise(F.col("text"))
    rows = rows.select("row", text.alias("clean"))
    n_chars = F.when(F.col("clean").eqNullSafe(F.col("row.text")), F.col("row.n_chars")).otherwise(F.length("clean").cast("long")) if "n_chars" in names else None
    return rows.select(*(F.col("clean").alias(n) if n == "text" else n_chars.alias(n) if n == "n_chars" else F.col("row")[n].alias(n) for n in names))
