"""Secret scanning with DataFrame functions only.

Three patterns find the base spans.  Beside them, character Markov models of
random strings and of ordinary identifiers are trained from labelled samples; in a
long run of token characters the part where the log-likelihood ratio favours the
random model most is a span of kind `markov`, so that a name or a path before a key
does not hide it.  Positions count code points, ends are exclusive.

Positions come from splitting a text at the matches: a match starts after the
lengths of all pieces and matches before it.  No pattern matches across lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The base patterns and their least lengths (of group 2 for assign).
_ANY_CASE = "|".join("".join(c if c in "_?" else f"[{c}{c.upper()}]" for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
ASSIGN = rf"({_ANY_CASE})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
#: Shorter runs fail, and no match starts inside one, so the least length can stand in the pattern.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "markov")

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
#: Runs scored by the Markov models.
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
_STATES = len(ALPHABET) + 1
#: Bits a character by which the random model must be the likelier one, least length of
#: the part of a run where it is, and bits beyond those in all.
THRESHOLD, LEAST_PART, LEAST_GAIN = 0.75, 16, 16.0

# Parts of ordinary identifiers, the labelled sample of such strings.
ORDINARY = """account action address agent amount application argument array attribute authentication author average background
balance baseline batch between billing boolean boundary branch buffer builder button cache callback cancel candidate category
channel character checkpoint children client cluster collection column command comment common compare complete component
condition config connection console constant container content context controller convert counter country create current customer
database dataset default definition delete description destination detail device dictionary different directory discount display
distance document domain driver duration dynamic element encoding endpoint engine entity environment error evaluate event example
exception exchange execute expected extension factory failure feature field filter folder format forward function gateway generate
handler header height history identifier image implement import index information initialize input instance integer interface
internal invoice iterator journal keyboard language layout length level library limit listener location manager mapping maximum
measure memory message method metric minimum missing module monitor namespace network notification number object observer offset
operation option order original output package parameter parent partition pattern payment pending performance permission""".split()


def let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(sizes: Column) -> Column:
    """For each element the sum of those before it, by blocks of 256: an array
    of m takes about 256 m steps."""
    block = 256

    def with_blocks(a: Column) -> Column:
        n = F.ceil(F.size(a) / block).cast("int")
        sums = F.transform(F.sequence(F.lit(1), n), lambda b: F.aggregate(F.slice(a, (b - 1) * block + 1, F.lit(block)), F.lit(0), lambda s, x: s + x))
        starts = let(sums, lambda t: F.transform(F.sequence(F.lit(0), F.size(t) - 1), lambda b: F.aggregate(F.slice(t, F.lit(1), b), F.lit(0), lambda s, x: s + x)))
        return let(
            starts,
            lambda st: F.transform(
                F.sequence(F.lit(0), F.size(a) - 1),
                lambda k: F.element_at(st, F.floor(k / block).cast("int") + 1)
                + F.aggregate(F.slice(a, (F.floor(k / block) * block).cast("int") + 1, k % block), F.lit(0), lambda s, x: s + x),
            ),
        )

    return F.when(F.size(sizes) == 0, F.array().cast("array<int>")).otherwise(let(sizes, with_blocks))


def found(text: Column, pattern: str, maybe: Column) -> Column:
    """All matches as array<struct<start, end, match>>; `maybe` is a cheap
    necessary condition."""
    none = F.array().cast("array<struct<start:int,end:int,match:string>>")

    def place(parts: Column) -> Column:
        m = parts["m"]
        before = F.transform(m, lambda x, i: F.char_length(F.get(parts["p"], i)) + F.char_length(x))
        return let(
            running(before),
            lambda at: F.transform(
                m,
                lambda x, i: F.struct(
                    (F.get(at, i) + F.char_length(F.get(parts["p"], i))).alias("start"),
                    (F.get(at, i) + F.char_length(F.get(parts["p"], i)) + F.char_length(x)).alias("end"),
                    x.alias("match"),
                ),
            ),
        )

    parts = F.struct(F.split(text, pattern, -1).alias("p"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))
    return F.when(maybe & text.rlike(pattern), let(parts, place)).otherwise(none)


def default_samples(spark: SparkSession) -> DataFrame:
    """(value, random): base64, hexadecimal and upper-case random strings made
    from digests, and identifiers in the usual styles made from ORDINARY."""
    i = spark.range(3000)
    digest = F.sha2(F.concat(F.lit("sample"), F.col("id").cast("string")), 256)
    pick = F.col("id") % 6
    base64 = F.regexp_replace(F.base64(F.unhex(digest)), "=+$", "")
    upper = F.upper(F.conv(F.substring(digest, 1, 14), 16, 36))
    random = F.when(pick < 4, base64).when(pick == 4, digest).otherwise(F.concat(upper, F.upper(F.conv(F.substring(digest, 20, 14), 16, 36))))
    words = F.array(*map(F.lit, ORDINARY))
    word = lambda salt: F.element_at(words, (F.pmod(F.hash(F.col("id"), F.lit(salt)), F.lit(len(ORDINARY))) + 1).cast("int"))
    a, b, c = word(1), word(2), word(3)
    style = F.col("id") % 10
    ordinary = (
        F.when(style < 3, F.concat(a, b, c))
        .when(style == 3, F.concat_ws("_", a, b, c))
        .when(style == 4, F.concat(a, F.initcap(b), F.initcap(c)))
        .when(style == 5, F.concat_ws("-", a, b, c))
        .when(style == 6, F.concat_ws("_", F.upper(a), F.upper(b), F.upper(c)))
        .when(style == 7, F.concat(F.lit("/"), F.concat_ws("/", a, b), F.lit("/"), c, (F.col("id") % 10).cast("string")))
        .when(style == 8, F.concat(F.initcap(a), F.initcap(b), F.initcap(c)))
        .otherwise(F.concat(F.repeat(F.element_at(F.array(*map(F.lit, "-=_+/")), (F.col("id") / 10 % 5 + 1).cast("int")), 30), a))
    )
    return i.select(random.alias("value"), F.lit(True).alias("random")).unionAll(i.select(ordinary.alias("value"), F.lit(False).alias("random")))


def _code(c: Column) -> Column:
    return F.instr(F.lit(ALPHABET), c)


def train(samples: DataFrame) -> list[float]:
    """Log2 ratio (random over ordinary) of each transition of two characters,
    the row of the start state first: at most 68 * 68 numbers, whatever the
    samples.  Counts get 0.2 each, so no transition is impossible."""
    chars = F.filter(F.split("value", ""), lambda c: c != "")
    pairs = samples.select("random", F.explode(F.transform(chars, lambda c, i: F.struct(F.when(i == 0, 0).otherwise(_code(F.get(chars, i - 1))).alias("a"), _code(c).alias("b")))).alias("p"))
    counts = pairs.groupBy("p.a", "p.b").agg(F.count_if("random").alias("r"), F.count_if(~F.col("random")).alias("o"))
    got = {(x["a"], x["b"]): (x["r"], x["o"]) for x in counts.collect()}
    import math

    out = []
    for a in range(_STATES):
        row = [got.get((a, b), (0, 0)) for b in range(1, _STATES)]
        totals = [sum(x[k] + 0.2 for x in row) for k in (0, 1)]
        out += [0.0, *(math.log2((x[0] + 0.2) / totals[0]) - math.log2((x[1] + 0.2) / totals[1]) for x in row)]
    return [round(x, 6) for x in out]


def best_part(value: Column, table: Column, threshold: float) -> Column:
    """struct<from, to, gain> of the part of a string over ALPHABET whose log2 ratios
    exceed the threshold by most in sum (gain): a running sum that starts anew where it
    would be negative, and its maximum.  The first among equals."""
    codes = F.transform(F.filter(F.split(value, ""), lambda c: c != ""), _code)
    zero, none = F.lit(0), F.lit(0.0)

    def step(s, c):
        extra = F.element_at(table, s["last"] * _STATES + c + 1) - threshold
        fresh = s["sum"] <= 0
        now, begin = F.when(fresh, extra).otherwise(s["sum"] + extra), F.when(fresh, s["at"]).otherwise(s["begin"])
        more = now > s["gain"]
        return F.struct(
            c.alias("last"), (s["at"] + 1).alias("at"), now.alias("sum"), begin.alias("begin"),
            F.when(more, begin).otherwise(s["from"]).alias("from"), F.when(more, s["at"] + 1).otherwise(s["to"]).alias("to"), F.when(more, now).otherwise(s["gain"]).alias("gain"),
        )

    start = F.struct(zero.alias("last"), zero.alias("at"), none.alias("sum"), zero.alias("begin"), zero.alias("from"), zero.alias("to"), none.alias("gain"))
    return F.aggregate(codes, start, step, lambda s: F.struct(s["from"].alias("from"), s["to"].alias("to"), s["gain"].alias("gain")))


def scan(docs: DataFrame, samples: DataFrame, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with `secrets`: array<struct<start, rank, end, kind>> in order of
    start, then of KINDS.  Null and empty texts have none.  One scan of the
    input, no shuffle; an existing column `secrets` is replaced, repeated rows stay.
    Work grows with a text's length, and with the square of its matches over 256."""
    table = F.from_json(F.lit(str(train(samples))), "array<double>")
    text = F.coalesce(F.col(text_col), F.lit(""))
    tagged = lambda spans, kind: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind")))
    assign = F.filter(found(text, ASSIGN, text.contains(":") | text.contains("=")), lambda s: F.char_length(F.regexp_extract(s["match"], ASSIGN, 2)) >= 6)
    access = found(text, ACCESS, text.contains("AKIA"))
    parts = F.transform(found(text, CANDIDATE, F.lit(True)), lambda s: F.struct(s["start"].alias("at"), best_part(s["match"], table, threshold).alias("b")))
    long = F.filter(parts, lambda s: (s["b"]["to"] - s["b"]["from"] >= LEAST_PART) & (s["b"]["gain"] >= LEAST_GAIN))
    markov = F.transform(long, lambda s: F.struct((s["at"] + s["b"]["from"]).alias("start"), (s["at"] + s["b"]["to"]).alias("end")))
    spans = F.concat(tagged(assign, "assign"), tagged(access, "access"), tagged(found(text, HEX, F.lit(True)), "hex"), tagged(markov, "markov"))
    return docs.withColumn("secrets", F.array_sort(spans))


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span, or run of overlapping spans, replaced by mark."""

    def step(s, x):
        gap = F.substring(text, s["at"] + 1, F.greatest(x["start"] - s["at"], F.lit(0)))
        new = F.when(x["start"] >= s["at"], F.array(gap, F.lit(mark))).otherwise(F.array().cast("array<string>"))
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), F.concat(s["out"], new).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    whole = F.aggregate(spans, start, step, lambda s: F.concat(F.array_join(s["out"], ""), F.substring(text, s["at"] + 1, F.char_length(text))))
    return F.when(F.size(spans) > 0, whole).otherwise(text)
