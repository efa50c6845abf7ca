"""Personal data by candidate gradient boosting, in DataFrame functions alone.

Validated patterns give the base spans. High-recall generators then propose wider, overlapping spans (obfuscated
mail addresses, spaced or bracketed numbers). Boosted trees score each candidate on features of its format and context, and a
threshold calibrated for each kind selects those to add. The trees are trained here, on the driver, over a synthetic set of
documented size whose features come from the same column expressions; scoring is a sum of CASE expressions over arrays, so
a document never leaves its row and nothing is shuffled.
"""

from __future__ import annotations

import functools
import random

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import documents

KINDS = ("email", "ip", "card", "phone")
MARK, SPARE = "\x01", "\x02"
EXAMPLES, TREES, DEPTH, RATE, PRECISION = 2000, 24, 3, 0.3, 0.99

# The lookbehinds only skip starts from which the same run has failed already; \G allows one right after a match. A run of
# fewer than twelve digits can't be a card, nor can any part of it, so the card pattern passes over it.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WIDE = {
    "email": r"(?i)(?<![A-Z0-9._%+-])[A-Z0-9._%+-]{1,64}+\x20?(?:@|\(at\)|\[at\])\x20?[A-Z0-9-]{1,63}+(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[A-Z0-9-]{1,63}+){1,6}+",
    "ip": r"(?<![0-9.])[0-9]{1,3}+(?:\x20?(?:\.|\[\.\]|\(\.\))\x20?[0-9]{1,3}+){3}+(?![0-9.]*[0-9])",
    "card": r"(?<![0-9A-Za-z])(?:[0-9]{4}[\x20.-]{0,2}){3}[0-9]{1,7}(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z.])(?:\+|00|\()?\x20?[0-9][0-9\x20()./-]{6,22}[0-9](?![0-9A-Za-z])",
}
NEEDED = {"email": r"@|(?i)[(\[]at[)\]]", "ip": r"[0-9][.\])\x20]", "card": r"[0-9]{4}", "phone": r"[0-9]"}
HINTS = {
    "email": r"(?i)(?:e-?mail|contact|write|address)\W{0,4}\w{0,4}\W{0,2}$",
    "ip": r"(?i)(?:\bip|host|server|addr\w*|client|from)\W{0,4}\w{0,4}\W{0,2}$",
    "card": r"(?i)(?:card|visa|amex|master\w*|credit|pay\w*)\W{0,4}\w{0,6}\W{0,3}$",
    "phone": r"(?i)(?:tel\w*|phone|call|fax|mobile|cell|whatsapp)\W{0,4}\w{0,4}\W{0,2}$",
}
RUN = 256
FEATURES = ("length", "digits", "dots", "dashes", "blanks", "brackets", "slashes", "groups", "longest", "octets", "luhn", "hint", "lead", "trail")
_SPANS = "array<struct<start:int,end:int,text:string>>"


def _parts(text: Column, pattern: str) -> Column:
    return F.split(F.regexp_replace(text, F.lit(pattern), F.lit(f"{MARK}$0{MARK}")), MARK, -1)


def located(parts: Column) -> Column:
    """Spans of the odd parts: code-point start, end and text of each match, in order.

    Matches are placed in runs of RUN, and the runs then one after another, as an array that grows is copied each time.
    """

    def step(state: Column, i: Column) -> Column:
        start = state["at"] + F.length(F.get(parts, i - 1))
        own = F.get(parts, i)
        end = start + F.length(own)
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(F.struct(start.alias("start"), end.alias("end"), own.alias("text")))).cast(_SPANS).alias("out"))

    none = F.array().cast(_SPANS)
    first = F.struct(F.lit(0).alias("at"), none.alias("out"))
    last = F.size(parts) - 2
    runs = F.transform(F.sequence(F.lit(1), last, F.lit(2 * RUN)), lambda lo: F.aggregate(F.sequence(lo, F.least(lo + 2 * RUN - 2, last), F.lit(2)), first, step))

    def after(state: Column, run: Column) -> Column:
        return F.struct((state["at"] + run["at"]).alias("at"), F.concat(state["starts"], F.array(state["at"])).alias("starts"))

    def moved(run: Column, by: Column) -> Column:
        return F.transform(run["out"], lambda x: F.struct((x["start"] + by).alias("start"), (x["end"] + by).alias("end"), x["text"].alias("text")))

    begun = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    many = F.flatten(F.zip_with(runs, F.aggregate(runs, begun, after, lambda s: s["starts"]), moved)).cast(_SPANS)
    one = F.aggregate(F.sequence(F.lit(1), last, F.lit(2)), first, step, lambda s: s["out"])
    return F.when(F.size(parts) <= 1, none).when(F.size(parts) <= 2 * RUN, one).otherwise(many)


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)

    def step(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + d - F.when(d > 9, 9).otherwise(0)

    return (n > 0) & (F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), step) % 10 == 0)


def _octets(text: Column) -> Column:
    parts = F.filter(F.split(text, r"[^0-9]+"), lambda p: p != "")

    def small(p: Column) -> Column:
        bare = F.regexp_replace(p, "^0+", "")
        return (F.length(bare) <= 3) & (F.when(bare == "", "0").otherwise(F.substring(bare, 1, 3)).cast("int") <= 255)

    return F.forall(parts, small)


def valid(kind: str, text: Column) -> Column:
    digits = digits_of(text)
    n = F.length(digits)
    return {
        "email": F.lit(True),
        "ip": _octets(text),
        "card": n.between(12, 19) & luhn(digits),
        "phone": n.between(9, 15),
    }[kind]


def base_parts(text: Column, kind: str) -> Column:
    """The text parted by a kind's base pattern; whole where it can't match."""
    guard = {"email": "@", "phone": "+", "ip": ".", "card": None}[kind]
    found = _parts(text, BASE[kind])
    return F.when(text.contains(guard), found).otherwise(F.array(text)) if guard else found


def wide_parts(text: Column, kind: str) -> Column:
    return F.when(text.rlike(NEEDED[kind]), _parts(text, WIDE[kind])).otherwise(F.array(text))


def feature_struct(kind: str, own: Column, before: Column, after: Column) -> Column:
    """Format and context features of a candidate; before and after are the neighbouring characters."""
    count = lambda pattern: F.regexp_count(own, F.lit(pattern))
    digits = digits_of(own)
    groups = F.filter(F.split(own, r"[^0-9A-Za-z]+"), lambda p: p != "")
    values = {
        "length": F.length(own), "digits": F.length(digits), "dots": count(r"\."), "dashes": count("-"), "blanks": count(" "),
        "brackets": count(r"[\[(]"), "slashes": count("/"), "groups": F.size(groups),
        "longest": F.coalesce(F.array_max(F.transform(groups, lambda g: F.length(g))), F.lit(0)),
        "octets": _octets(own).cast("int"), "luhn": luhn(digits).cast("int"), "hint": before.rlike(HINTS[kind]).cast("int"),
        "lead": before.rlike(r"[0-9A-Za-z./:+-]$").cast("int"), "trail": after.rlike(r"^(?:[A-Za-z/:@-]|\.[0-9])").cast("int"),
    }
    return F.struct(*[values[f].cast("double").alias(f) for f in FEATURES])


# ---------------------------------------------------------------------------------------------------------------- training


def _examples(kind: str, n: int = EXAMPLES) -> list[tuple[str, str, str, int]]:
    """Synthetic candidates (before, text, after, label), half of them personal data, from a fixed seed."""
    r = random.Random(f"examples of {kind}")
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 8)))
    sep = lambda: r.choice([" ", "-", ".", ""])

    def checked(k: int) -> str:
        body = str(r.randint(3, 6)) + num(k - 2)
        total = sum(d - 9 if d > 9 else d for d in (int(c) * (2 if i % 2 == 0 else 1) for i, c in enumerate(reversed(body))))
        return body + str(-total % 10)

    def grouped(s: str) -> str:
        mark = r.choice([" ", "-", ".", ""])
        return mark.join(s[i : i + 4] for i in range(0, len(s), 4))

    def octet(top: int) -> str:
        return str(r.randint(0, top))

    def yes() -> str:
        if kind == "email":
            at, dot = r.choice([("@", "."), (" (at) ", " (dot) "), ("[at]", "[dot]"), (" [at] ", "."), ("(at)", ".")])
            return f"{word()}{r.choice(['', '.' + word(), num(2)])}{at}{word()}{dot}{r.choice(['com', 'org', 'net', 'de', 'fr', 'es'])}"
        if kind == "ip":
            dot = r.choice([".", "[.]", "(.)", " . "])
            return dot.join(octet(255) for _ in range(4))
        if kind == "card":
            return grouped(checked(r.choice([13, 15, 16, 16, 16, 19])))
        s = sep()
        return r.choice(
            [f"+{num(1)} ({num(3)}) {num(3)}-{num(4)}", f"({num(3)}) {num(3)}-{num(4)}", s.join((num(3), num(3), num(4))), f"00{num(2)} {num(2)} {num(7)}", f"+{num(2)}{s}{num(3)}{s}{num(6)}"]
        )

    def no() -> str:
        if kind == "email":
            return r.choice([f"{word()} @ {word()}.{num(2)}", f"{num(1)}@{num(2)}.{num(1)}", f"{word()}@{num(3)}.{num(3)}", f"{num(2)} @ {num(1)}.{num(2)}"])
        if kind == "ip":
            return r.choice([".".join(("0", octet(9), octet(9), octet(9))), ".".join((octet(2), octet(9), octet(9), octet(9))), ".".join(str(r.randint(256, 999)) for _ in range(4)), f"{octet(31)} . {octet(12)} . {num(2)} . {num(2)}"])
        if kind == "card":
            text = num(r.choice([13, 14, 16, 19]))
            return grouped(text)
        return r.choice(
            [f"{r.randint(1900, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}", f"{num(2)}/{num(2)}/{num(4)}", f"978-{num(1)}-{num(2)}-{num(6)}-{num(1)}",
             num(r.choice([8, 12, 14, 16, 20])), f"{r.randint(1900, 1999)}-{r.randint(2000, 2030)}", f"{num(1)}.{num(3)}.{num(3)}", " ".join(num(2) for _ in range(5)), f"{num(3)} / {num(3)}", f"{num(4)} {num(4)}"]
        )

    hints = {"email": "email: ", "ip": "host ", "card": "card ", "phone": "tel. "}
    rows = []
    for i in range(n):
        label = i % 2
        before = r.choice([f"{word()} ", f"{word()}, ", hints[kind] if r.random() < (0.7 if label else 0.1) else f"{word()} ", "" if label else r.choice(["", "v", "/", "$"])])
        after = r.choice([" ", ".", ",", f" {word()}", "" if label else r.choice(["", "-x", "/", ".1"])])
        rows.append((before, yes() if label else no(), after, label))
    return rows


def _tree(x: np.ndarray, grad: np.ndarray, hess: np.ndarray, depth: int, reg: float = 1.0):
    """A regression tree on gradients: (feature, cut, left, right), or the leaf's value."""
    leaf = float(-grad.sum() / (hess.sum() + reg))
    if depth == 0 or len(x) < 8:
        return leaf
    best, whole = (1e-6, None, None), grad.sum() ** 2 / (hess.sum() + reg)
    for j in range(x.shape[1]):
        for cut in np.unique(x[:, j])[:-1]:
            left = x[:, j] <= cut
            if min(left.sum(), (~left).sum()) < 4:
                continue
            gain = sum(grad[s].sum() ** 2 / (hess[s].sum() + reg) for s in (left, ~left)) - whole
            if gain > best[0]:
                best = (gain, j, float(cut))
    if best[1] is None:
        return leaf
    left = x[:, best[1]] <= best[2]
    return best[1], best[2], _tree(x[left], grad[left], hess[left], depth - 1, reg), _tree(x[~left], grad[~left], hess[~left], depth - 1, reg)


def _value(tree, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, float):
        return np.full(len(x), tree)
    return np.where(x[:, tree[0]] <= tree[1], _value(tree[2], x), _value(tree[3], x))


def boost(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> list:
    """Gradient boosting of logistic loss."""
    out, logit = [], np.zeros(len(x))
    for _ in range(trees):
        p = 1 / (1 + np.exp(-logit))
        tree = _tree(x, p - y, p * (1 - p), depth)
        out.append(tree)
        logit += rate * _value(tree, x)
    return out


def calibrated(logit: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The least logit above which a held-out share of `precision` is right."""
    order = np.argsort(-logit)
    right = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    good = np.flatnonzero(right >= precision)
    return float(logit[order][good[-1]]) if len(good) else float("inf")


def _case(tree, rate: float) -> str:
    if isinstance(tree, float):
        return f"{rate * tree!r}D"
    return f"(CASE WHEN c.{FEATURES[tree[0]]} <= {tree[1]!r}D THEN {_case(tree[2], rate)} ELSE {_case(tree[3], rate)} END)"


@functools.lru_cache(maxsize=1)
def _trained(app: str, spark) -> dict[str, tuple[str, float]]:
    rows = [(kind, i, *row) for kind in KINDS for i, row in enumerate(_examples(kind))]
    table = spark.createDataFrame(rows, "kind string, i int, before string, text string, after string, label int")
    out = {}
    for kind in KINDS:
        own = table.where(F.col("kind") == kind).select("i", "label", feature_struct(kind, F.col("text"), F.col("before"), F.col("after")).alias("f"))
        got = own.orderBy("i").collect()  # EXAMPLES rows
        x, y = np.array([tuple(r["f"]) for r in got], float), np.array([r["label"] for r in got], float)
        fold = (np.arange(len(x)) // 2) % 4 == 3
        trees = boost(x[~fold], y[~fold])
        held = RATE * sum(_value(t, x[fold]) for t in trees)
        out[kind] = (" + ".join(_case(t, RATE) for t in trees), max(0.0, calibrated(held, y[fold], PRECISION)))
    return out


def model(spark) -> dict[str, tuple[str, float]]:
    """For each kind the SQL of its boosted score over a feature struct c, and its calibrated threshold."""
    return _trained(spark.sparkContext.applicationId, spark)


# ----------------------------------------------------------------------------------------------------------------- scoring


def _validated(kind: str):
    return lambda s: valid(kind, s["text"])


def _candidate(text: Column, kind: str):
    """From a wide span to one with its features."""

    def made(s: Column) -> Column:
        before = F.substring(text, F.greatest(s["start"] - 23, F.lit(1)), F.least(s["start"], F.lit(24)))
        f = feature_struct(kind, s["text"], before, F.substring(text, s["end"] + 1, F.lit(2)))
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), f.alias("f"))

    return made


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, keep_text: bool = False) -> DataFrame:
    """One row per document: doc_id, base and spans, arrays of (start, end, kind) in order of start, then kind.

    Offsets are code points, ends exclusive. base holds the validated pattern matches, leftmost and not overlapping within
    a kind; spans adds the selected candidates that overlap no base span; of candidates of several kinds that overlap the one
    furthest above its kind's threshold is taken first. Very long texts are searched whole. Null and empty texts have none. Repeated rows are
    each looked at, a null id stays null, other columns are ignored.
    """
    trained = model(docs.sparkSession)
    own = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    kept = ["own_text"] * keep_text
    # the mark that parts a text must not stand in it; code points keep their places
    rows = docs.select(F.col(id_col).alias("doc_id"), *[own.alias(c) for c in kept], F.translate(own, MARK, SPARE).alias("t"))
    t = F.col("t")
    # each step is a column of its own: a lambda over an expression would part the text again at every match
    rows = rows.select("*", *[base_parts(t, kind).alias(f"b_{kind}") for kind in KINDS], *[wide_parts(t, kind).alias(f"w_{kind}") for kind in KINDS])
    rows = rows.select("doc_id", *kept, "t", *[located(F.col(f"{side}_{kind}")).alias(f"{side}_{kind}") for side in "bw" for kind in KINDS])
    rows = rows.select(
        "doc_id", *kept, "t", *[F.filter(f"b_{kind}", _validated(kind)).alias(f"b_{kind}") for kind in KINDS],
        *[F.transform(f"w_{kind}", _candidate(t, kind)).alias(f"w_{kind}") for kind in KINDS],
    )
    span = "struct<start:int,rank:int,end:int,kind:string>"

    def tagged(column: str, kind: str) -> str:
        return f"transform({column}, s -> named_struct('start', s.start, 'rank', {KINDS.index(kind)}, 'end', s.end, 'kind', '{kind}'))"

    base = "array_sort(concat(" + ", ".join(tagged(f"b_{k}", k) for k in KINDS) + f", cast(array() as array<{span}>)))"
    rows = rows.withColumn("base", F.expr(base))
    more = []
    for kind in KINDS:
        score, threshold = trained[kind]
        if threshold == float("inf"):
            continue
        clear = "not exists(base, b -> b.start < w.end and w.start < b.end)"
        above = f"aggregate(array(w.f), 0D, (total, c) -> total + {score}) - {threshold!r}D"
        scored = f"transform(filter(w_{kind}, w -> {clear}), w -> named_struct('below', -({above}), 'start', w.start, 'rank', {KINDS.index(kind)}, 'end', w.end, 'kind', '{kind}'))"
        more.append(f"filter({scored}, a -> a.below <= 0)")
    wide = f"array<struct<below:double,{span.removeprefix('struct<')}>"
    rows = rows.withColumn("added", F.expr("concat(" + ", ".join([*more, f"cast(array() as {wide})"]) + ")"))
    met = "o.start < a.end and a.start < o.end"
    rows = rows.withColumn("clash", F.expr(f"filter(added, a -> exists(added, o -> o.rank <> a.rank and {met}))"))
    taken = f"aggregate(array_sort(clash), cast(array() as {wide}), (kept, a) -> if(exists(kept, o -> {met}), kept, concat(kept, array(a))))"
    alone = "if(size(clash) = 0, added, array_except(added, clash))"
    plain = "a -> named_struct('start', a.start, 'rank', a.rank, 'end', a.end, 'kind', a.kind)"
    return rows.select("doc_id", *kept, "base", F.expr(f"array_sort(concat(base, transform(concat({alone}, {taken}), {plain})))").alias("spans"))


def listed(spans: str) -> Column:
    """kind:start:end of an array of spans, comma-joined."""
    return F.expr(f"array_join(transform({spans}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and redacted: each text with its spans replaced by their kind in angle brackets; a span that begins inside another is left out."""
    return personal_data(docs, id_col, text_col, keep_text=True).select(
        "doc_id",
        F.expr(
            "aggregate(spans, named_struct('at', 0, 'out', ''), (a, s) -> if(s.start < a.at, a, named_struct('at', s.end, 'out', "
            "concat(a.out, substring(own_text, a.at + 1, s.start - a.at), '<', s.kind, '>'))), a -> concat(a.out, substring(own_text, a.at + 1)))"
        ).alias("redacted"),
    )


def op5_pii(spark, sf_dir: str) -> DataFrame:
    n = [F.expr(f"cast(size(filter(base, s -> s.kind = '{kind}')) as bigint)").alias(f"n_{kind}") for kind in KINDS]
    return personal_data(documents(spark, sf_dir)).select("doc_id", *n, F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))
