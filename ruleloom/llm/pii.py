"""Personal data by candidate gradient boosting, in DataFrame functions only.

Fixed formats (mail, network and card numbers, phone numbers) give the base spans, which always stay. High-recall
generators propose further, overlapping candidates of any length: whatever looks like a mail address, written out or not, long numbers with
mixed separators, and the same with one separator. Each candidate has discrete features of its format and context. Boosted trees are fitted on
the table of feature combinations over all documents, its size bounded by the features' values whatever the corpus.

The base formats do not decide alone what the trees learn. Weak labels: a candidate is a positive example if it meets a base span or a telling
word ("phone", "account", ...) stands before it, in the text since the last candidate of the kind. The checks behind base spans (Luhn sums, octets up to 255, domains' alphabets) are no features. And every
positive example also counts without its marks, the plus sign and the telling word, so that formats are learned which mostly occur with a mark but
are written without it as well. Thresholds are calibrated per kind: trees of one half of the documents score the other half's cells, and the
lowest score whose cells and all above reach ``PRECISION`` on the weak labels is the kind's threshold.

The trees become one SQL expression. Candidates that meet no base span and reach their kind's threshold are selected; of overlapping ones the longest
stays (ties: the better score, then the earlier), and they are reported as ``contact`` or ``number``.

Everything stays in the document's row, so nothing but the table of combinations is shuffled. Positions are code points.
Defined cases: null and empty texts have no spans; texts of any length are read whole; equal scores tie as above; repeated rows get equal rows; rows with a
null ``doc_id`` keep it; an empty table gives an empty result; with positive or negative examples missing no candidate is added; columns other than ``doc_id``
and ``text`` are not read, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LOCAL, _HOST = "A-Za-z0-9._%+-", "A-Za-z0-9-"
# A run can only match from its beginning or from where the last match ended; possessive parts never give back.
EMAIL = rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[{_HOST}]++(?:\.[{_HOST}]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])[0-9](?:[ -]?[0-9])++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
_AT = r"(?:@| ?[\[(]at[\])] ?)"
MAIL_LIKE = rf"(?<![^\s<>(\"'])[^\s<>()\"'@]++{_AT}[^\s<>()\"'@]++(?: ?[\[(]dot[\])] ?[A-Za-z]++)*+"
NUMBER_LIKE = r"(?<![0-9A-Za-z])[+(]?[0-9](?:[ ().-]{0,2}[0-9]){6,}+(?![0-9A-Za-z])"
#: A number with one kind of separator, of seven digits or more.
PLAIN_NUMBER = r"(?<![0-9A-Za-z])[0-9]++(?:([ .-])[0-9]++(?:\1[0-9]++)*+)?+(?![0-9A-Za-z])"
_TELLING = "(?i)(?:phone|tel|call|fax|mobile|card|visa|credit|account|ssn|passport|mail|contact|address|addr|host|ip)[^A-Za-z]{0,3}$"
KINDS = ("email", "ip", "card", "phone", "contact", "number")
ROUNDS, RATE, PRECISION, CONTEXT = 24, 0.4, 0.9, 24
#: Numbers summed in one go, and the most blocks of a text by which base spans are looked up.
RUN, BLOCKS = 256, 512
#: Feature names and their largest value; the smallest is 0. Kinds of candidates: 0 number, 1 mail, 2 number of one separator.
FEATURES = {"kind": 2, "digits": 20, "separators": 3, "plus": 1, "groups": 5, "telling": 1, "before": 2, "after": 2, "domain": 1, "dull": 1}
#: Features that a positive example is also learned without.
MARKS = ("plus", "telling")


def _cut(text: Column, pattern: str) -> tuple[Column, Column]:
    """All leftmost non-overlapping matches, and the texts between them."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)


def _running(steps: Column) -> Column:
    """Running sums of an array of numbers; long arrays by parts of ``RUN`` numbers, as appending copies the array."""
    plain = lambda a: F.aggregate(a, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / RUN).cast("int")), lambda k: plain(F.slice(steps, k * RUN + 1, F.lit(RUN))))
    before = plain(F.transform(parts, lambda p: F.element_at(p, -1)))
    # one element more than parts; the last has no partner and is left out
    moved = F.zip_with(parts, before, lambda p, b: F.transform(F.filter(p, lambda x, i: i > 0), lambda x: x + b))
    long = F.flatten(F.filter(moved, lambda p: p.isNotNull()))
    return F.when(F.size(steps) <= RUN, F.filter(plain(steps), lambda x, i: i > 0)).otherwise(long)


def _places(name: str) -> Column:
    """``array<struct<s, e, m, before, after>>`` from the matches ``_h<name>`` and the gaps ``_g<name>``: places follow from the lengths, and what
    stands before and after a match is the end and the beginning of the gaps around it.

    The arrays are arguments of the functions and not captured in a lambda, which would compute them once per element.
    """
    steps = F.zip_with(f"_h{name}", f"_g{name}", lambda m, g: F.length(g) + F.coalesce(F.length(m), F.lit(0)))
    told = F.zip_with(f"_h{name}", f"_g{name}", lambda m, g: F.struct(m.alias("m"), F.right(g, F.lit(CONTEXT)).alias("before")))
    told = F.zip_with(told, F.slice(f"_g{name}", F.lit(2), F.size(f"_g{name}")), lambda x, g: F.struct(x["m"].alias("m"), x["before"].alias("before"), F.left(g, F.lit(1)).alias("after")))
    spans = F.zip_with(told, _running(steps), lambda x, e: F.struct((e - F.length(x["m"])).alias("s"), e.cast("int").alias("e"), x["m"].alias("m"), x["before"].alias("before"), x["after"].alias("after")))
    return F.filter(spans, lambda x: x["m"].isNotNull())


def _digits(m: Column) -> Column:
    return F.length(m) - F.length(F.translate(m, "0123456789", ""))


def _luhn(m: Column) -> Column:
    d = F.reverse(F.translate(m, " -", ""))
    total = F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), lambda acc, i: acc + _luhn_digit(d.substr(i, F.lit(1)).cast("int"), i % 2 == 0))
    return total % 10 == 0


def _luhn_digit(x: Column, doubled: Column) -> Column:
    return F.when(~doubled, x).when(x > 4, 2 * x - 9).otherwise(2 * x)


def _found(df: DataFrame) -> DataFrame:
    """Adds arrays ``email, ip, card, phone`` of valid base spans and ``wide`` of candidates with features, to ``df(text)``."""
    t = F.col("text")
    # cheap tests first: most texts have nothing of a kind, and a null text costs nothing below
    df = df.select("*",
                   F.when(t.contains("@") | t.contains("at)") | t.contains("at]"), t).alias("_mail"),
                   F.when(t.rlike(r"[0-9]\.[0-9]"), t).alias("_dots"),
                   F.when(t.rlike(r"[0-9](?:[ -]?[0-9]){15}"), t).alias("_long"),
                   F.when(t.contains("+"), t).alias("_plus"),
                   F.when(t.rlike(r"[0-9](?:[ ().-]{0,2}[0-9]){6}"), t).alias("_number"))
    none = F.array().cast("array<struct<s:int,e:int,m:string,before:string,after:string>>")
    cuts = {"email": ("_mail", EMAIL), "ip": ("_dots", IP), "card": ("_long", CARD), "phone": ("_plus", PHONE), "mails": ("_mail", MAIL_LIKE), "numbers": ("_number", NUMBER_LIKE), "plain": ("_number", PLAIN_NUMBER)}
    df = df.select("*", *(c.alias(f"_{k}{name}") for name, (column, pattern) in cuts.items() for k, c in zip("hg", _cut(F.col(column), pattern), strict=True)))
    df = df.select("*", *(F.coalesce(_places(name), none).alias(f"_{name}") for name in cuts))
    df = df.select("*", F.col("_email").alias("email"),
                   F.filter("_ip", lambda x: x["m"].rlike(rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$")).alias("ip"),
                   F.filter("_phone", lambda x: _digits(x["m"]).between(8, 15)).alias("phone"),
                   F.filter("_card", lambda x: _digits(x["m"]).between(16, 19)).alias("_sized"))
    df = df.withColumn("card", F.filter("_sized", lambda x: _luhn(x["m"])))
    df = df.withColumn("_every", F.transform(F.concat("email", "ip", "card", "phone"), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))))
    # base spans by block of the text, so that a candidate is compared with those near it
    df = df.withColumn("_width", F.greatest(F.lit(1024), F.ceil(F.coalesce(F.length(t), F.lit(0)) / BLOCKS)).cast("int"))
    last = F.when(F.size("_every") > 0, F.floor(F.coalesce(F.length(t), F.lit(0)) / F.col("_width"))).otherwise(0).cast("int")
    df = df.withColumn("_base", F.transform(F.sequence(F.lit(0), last), lambda k: F.filter("_every", lambda x: (x["s"] < (k + 1) * F.col("_width")) & (x["e"] > k * F.col("_width")))))
    df = df.withColumn("_plain", F.filter("_plain", lambda c: _digits(c["m"]) >= 7))
    wide = F.concat(*(_all_described(name, kind) for kind, name in enumerate(("_numbers", "_mails", "_plain"))))
    return df.withColumn("wide", wide)


def _all_described(name: str, kind: int) -> Column:
    return F.transform(name, lambda c: _described(c, kind))


def _described(c: Column, kind: int) -> Column:
    m, before, after = c["m"], c["before"], F.coalesce(c["after"], F.lit(""))
    last = F.right(before, F.lit(1))

    def side(x: Column) -> Column:
        return F.when((x == "") | x.rlike(r"\s"), 0).when(x.rlike("[A-Za-z0-9]"), 2).otherwise(1)

    plain = F.translate(m, "0123456789", "")
    separators = F.when(plain == "", 0).when(F.translate(plain, ".", "") == "", 1).when(F.translate(plain, " -", "") == "", 2).otherwise(3)
    groups = F.size(F.filter(F.split(m, "[^0-9]+", -1), lambda g: g != ""))
    first, past = F.floor(c["s"] / F.col("_width")), F.floor((c["e"] - 1) / F.col("_width"))
    near = F.slice("_base", (first + 1).cast("int"), (past - first + 1).cast("int"))
    met = F.exists(near, lambda block: F.exists(block, lambda b: (b["s"] < c["e"]) & (c["s"] < b["e"])))
    number = {
        "digits": F.least(_digits(m), F.lit(20)), "separators": separators, "groups": F.least(groups, F.lit(5)), "plus": m.startswith("+").cast("int"),
        "dull": (F.size(F.array_distinct(F.split(F.regexp_replace(m, "[^0-9]", ""), ""))) <= 3).cast("int")}
    # digits say nothing about an address
    mail = {"domain": m.rlike(rf"{_AT}[^\s.]+(?:\.| ?[\[(]dot[\])] ?)\p{{L}}{{2,}}").cast("int")}
    own = {"kind": F.lit(kind), "telling": before.rlike(_TELLING).cast("int"), "before": side(last), "after": side(after)} | (mail if kind == 1 else number)
    return F.struct(c["s"].alias("s"), c["e"].alias("e"), met.alias("met"), *(own.get(n, F.lit(0)).cast("int").alias(n) for n in FEATURES))


def _unmarked(cells: list[dict]) -> list[dict]:
    """``cells`` and, for their positive examples, the same cells without each subset of their marks."""
    out: dict[tuple, dict] = {}
    for cell in cells:
        variants = [cell]
        for mark in MARKS:
            variants += [v | {mark: 0, "no": 0} for v in variants if v[mark] and v["yes"]]
        for v in variants:
            own = out.setdefault(tuple(v[n] for n in FEATURES) + (v["fold"],), v | {"yes": 0, "no": 0})
            own["yes"] += v["yes"]
            own["no"] += v["no"]
    return list(out.values())


def grow(x: np.ndarray, yes: np.ndarray, no: np.ndarray) -> list[tuple]:
    """Trees of depth two over weighted cells; ``x`` has a column per feature. Without examples of both sorts there is none.

    A tree is ``(feature, cut, left, right)`` with leaves as numbers; a value up to the cut goes left.
    """
    if not yes.sum() or not no.sum():
        return []
    prior = math.log(yes.sum() / no.sum())
    trees: list[tuple] = [(next(iter(FEATURES)), 0, prior, prior)]
    score = np.full(len(x), prior)
    for _ in range(ROUNDS):
        share = 1 / (1 + np.exp(-score))
        tree = _tree(x, yes - (yes + no) * share, (yes + no) * share * (1 - share), np.arange(len(x)), 2)
        if not isinstance(tree, tuple):
            break
        trees.append(tree)
        score += scores([tree], x)
    return trees


def _tree(x: np.ndarray, pull: np.ndarray, curve: np.ndarray, own: np.ndarray, depth: int):
    g, h = pull[own].sum(), curve[own].sum()
    best, split = 1e-6, None
    for column, (name, top) in enumerate(FEATURES.items()) if depth else ():
        lg, lh = (np.cumsum(np.bincount(x[own, column], w[own], top + 1))[:top] for w in (pull, curve))
        gain = lg * lg / (lh + 1) + (g - lg) ** 2 / (h - lh + 1) - g * g / (h + 1)
        if gain.max() > best:
            best, split = gain.max(), (name, int(gain.argmax()), column)
    if split is None:
        return float(RATE * g / (h + 1))
    name, cut, column = split
    low = x[own, column] <= cut
    return name, cut, _tree(x, pull, curve, own[low], depth - 1), _tree(x, pull, curve, own[~low], depth - 1)


def scores(trees: list[tuple], x: np.ndarray) -> np.ndarray:
    """Summed leaves of every cell."""
    columns = {name: i for i, name in enumerate(FEATURES)}

    def one(tree) -> np.ndarray | float:
        if not isinstance(tree, tuple):
            return tree
        return np.where(x[:, columns[tree[0]]] <= tree[1], one(tree[2]), one(tree[3]))

    return sum((one(t) for t in trees), np.zeros(len(x)))


Model = tuple[list[tuple], dict[int, float]]


def boost(cells: list[dict]) -> Model:
    """Trees over cells (features, ``fold`` 0 or 1, ``yes``, ``no``), and the threshold of each kind that has one."""
    cells = _unmarked(cells)
    if not cells:
        return [], {}
    x = np.array([[c[n] for n in FEATURES] for c in cells])
    yes, no, fold = (np.array([c[k] for c in cells], float) for k in ("yes", "no", "fold"))
    trees = grow(x, yes, no)
    # each half is scored by trees that have not seen it
    crossed, known = np.zeros(len(x)), np.ones(len(x), bool)
    for k in (0, 1):
        own = grow(x[fold != k], yes[fold != k], no[fold != k])
        crossed[fold == k] = scores(own, x[fold == k])
        known[fold == k] = bool(own)
    cuts = {}
    for kind in range(FEATURES["kind"] + 1) if trees else ():
        at = np.flatnonzero((x[:, 0] == kind) & known)
        at = at[np.argsort(-crossed[at], kind="stable")]
        good = np.cumsum(yes[at]) >= PRECISION * np.cumsum(yes[at] + no[at])
        # cells of one score stand or fall together
        good &= np.append(crossed[at][1:] < crossed[at][:-1], True)[: len(at)]
        if good.any():
            cuts[kind] = float(crossed[at][np.flatnonzero(good)[-1]]) - 1e-9  # sums in another order differ in the last digits
    return trees, cuts


def _scored(trees: list[tuple], c: Column) -> Column:
    def one(tree) -> Column:
        if not isinstance(tree, tuple):
            return F.lit(float(tree))
        return F.when(c[tree[0]] <= tree[1], one(tree[2])).otherwise(one(tree[3]))

    total = F.lit(0.0)
    for tree in trees:
        total = total + one(tree)
    return total


def fit(docs: DataFrame) -> Model:
    """Boosted trees and thresholds from all candidates of ``docs(text)``; at most two rows per feature combination are collected."""
    fold = F.pmod(F.xxhash64("text"), F.lit(2)).cast("int").alias("fold")
    # an inner explode infers a filter that repeats the whole expression below it
    rows = _found(docs.select("text")).select(fold, F.explode_outer("wide").alias("c")).where("c IS NOT NULL").select("fold", "c.met", *(F.col(f"c.{n}") for n in FEATURES))
    yes = F.col("met") | (F.col("telling") == 1)
    cells = rows.groupBy(*FEATURES, "fold").agg(F.count_if(yes).alias("yes"), F.count_if(~yes).alias("no"))
    return boost([r.asDict() for r in cells.orderBy(*FEATURES, "fold").collect()])


def _apart(spans: Column) -> Column:
    """Of overlapping ``spans(s, e, kind, score)`` the longest, then the best score, then the earliest; a chain of overlaps is settled from the left."""
    rank = lambda x: F.struct(x["e"] - x["s"], x["score"], -x["s"])
    none = F.array().cast("array<struct<s:int,e:int,kind:int,score:double>>")

    def take(kept, x):
        last = F.try_element_at(kept, F.lit(-1))
        clear = last.isNull() | (last["e"] <= x["s"])
        better = F.concat(F.slice(kept, F.lit(1), F.size(kept) - 1), F.array(x))
        return F.when(clear, F.concat(kept, F.array(x))).when(rank(x) > rank(last), better).otherwise(kept)

    return F.aggregate(F.array_sort(spans), none, take)


def find(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: counts and spans, base spans apart and with the added ones."""
    trees, cuts = fit(docs) if model is None else model
    df = _found(docs.select("doc_id", "text"))
    scored = F.transform(F.filter("wide", lambda c: ~c["met"]), lambda c: F.struct(c["s"].alias("s"), c["e"].alias("e"), c["kind"].alias("kind"), _scored(trees, c).alias("score")))
    reached = lambda c: F.coalesce(*(F.when(c["kind"] == k, c["score"] >= cut) for k, cut in cuts.items()), F.lit(False))
    # a text without candidates costs nothing here
    df = df.withColumn("_added", F.when(F.size("wide") > 0, _apart(F.filter(scored, reached))).otherwise(F.array().cast("array<struct<s:int,e:int,kind:int,score:double>>")))

    def shown(column, kind: str) -> Column:
        return F.transform(column, lambda x: F.concat(F.lit(f"{kind}:"), x["s"].cast("string"), F.lit(":"), x["e"].cast("string")))

    base = [shown(k, k) for k in KINDS[:4]]
    more = [shown(F.filter("_added", lambda c: c["kind"] == 1), "contact"), shown(F.filter("_added", lambda c: c["kind"] != 1), "number")]
    return df.select(
        "doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:4]),
        F.sha2(F.array_join(F.concat(*base), ","), 256).alias("base_sha256"),
        F.array_join(F.concat(*base, *more), ",").alias("spans"), F.size("_added").cast("long").alias("n_added"))
