"""Personal data: overlapping candidate spans, boosted trees, calibrated thresholds, redaction.

DataFrame functions only.  Four base kinds are found by pattern and check and
are always redacted.  Around them, generators of high recall propose spans
that may overlap each other and the base ones: numbers with any grouping,
and addresses with spelled-out signs.  Boosted trees of each kind score a candidate by
its format (length, digits, groups, signs, check digit) and context (the
characters and words beside it).  What passes the threshold of its kind and
touches no base span is redacted too; of selected candidates that overlap, the
one with the best score is taken first.

The trees learn from a sample of about ``sample_docs`` documents, chosen by a
hash of the id, in which every base span is masked: half of them (by a hash)
get a form no base pattern finds (signs spelled out, no ``+`` or country code,
other separators, a contact word beside a plain number), half a look-alike
that isn't personal (no domain, a wrong check digit, a part over 255, a date).
A candidate that is a masked form is positive; look-alikes, parts and overlong
spans are negative, and so are the texts' other numbers and signs, unless a
contact word stands right before them (positive) or near them, or they have
the form of personal data (both not learned from, for they may be some).  The
threshold of a kind is the least at which, on all documents outside the fit,
the candidates that win among those that overlap are right with ``precision``,
``LEAST_WINNERS`` of them at least; a kind without such a threshold selects
nothing.  The base spans of those documents are masked with other forms than
any the trees were fitted on.  The precision is that on forms and look-alikes
in equal numbers, not on a text's own mixture.

A fitted model becomes a column expression, so finding and redacting is one
pass over the documents without a shuffle or join.  Patterns are written so
that they take time in proportion to the text (possessive, starting at the
start of a run only).  Places are prefix sums by doubling, spans are looked up
by halving, and texts are put together from blocks, so n spans of one text
take some n log n steps; only a chain of c selected candidates of which each
overlaps the next takes c * c.

Null text counts as empty and has no spans; redaction leaves null as null.
Repeated rows are handled alike.  Positions are code points, ends exclusive.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartflow.llm.common import cut, own_names

KINDS = ("email", "ip", "card", "phone")
LOCAL, HOST = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
EMAIL = rf"(?:\G|(?<!{LOCAL})){LOCAL}++@{HOST}++(?:\.{HOST}++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?=(?:[0-9][\x20-]?){11}[0-9])[0-9]++(?:[\x20-][0-9]++)*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Generators: spans that may be personal data, whether or not they pass the checks of the base kinds.
NUMBER = r"(?:\G|(?<![0-9A-Za-z]))[+(]{0,2}[0-9]++(?:[\x20().:/-]{1,2}[0-9]++)*+"
AT, DOT = r"(?:@|[(\[{<]at[)\]}>])", r"(?:[(\[{<]dot[)\]}>])"
SPELLED = rf"(?i)(?:\G|(?<!{LOCAL})){LOCAL}++\x20?{AT}\x20?{HOST}++(?:\x20?(?:\.|{DOT})\x20?{HOST}++)*+"
#: The same without blanks, so that neighbours or the next sentence aren't taken along, and the usual shape of a phone number.
TIGHT_NUMBER = r"(?<![0-9A-Za-z])[+(]?[0-9]++(?:(?:\[\.\]|\(\.\)|\{\.\}|[().:/_-]{1,2})[0-9]++)*+"
TIGHT_SPELLED = rf"(?i)(?<!{LOCAL}){LOCAL}++\x20?{AT}\x20?{HOST}++(?:(?:\.|\x20?{DOT}\x20?){HOST}++)*+"
IN_WORDS = rf"(?i)(?<!{LOCAL}){LOCAL}++\x20at\x20{HOST}++(?:\.{HOST}++)*+(?:\x20dot\x20{HOST}++(?:\.{HOST}++)*+)++"
GROUPED = r"(?<![0-9A-Za-z+])(?:[0-9]{1,3}[\x20.-])?(?:\([0-9]{2,5}\)|[0-9]{2,5})[\x20./-]{1,2}[0-9]{3,4}[\x20.-]?[0-9]{3,4}(?![0-9])"
SET_APART = r"(?<![0-9A-Za-z])[0-9]{1,6}(?:\x20[._-]\x20[0-9]{1,6}){2,}+(?![0-9])"
#: A run of more digits is several numbers: the generators that stop at blanks propose them one by one.
MOST_DIGITS = 19
CONTEXT = 24
TEXT_BLOCK = 1024
KEYWORDS = r"(?i)(tel|phone|call|mobil|fax|mail|contact|card|visa|iban|account|addr|host|ssn|born|kontakt|correo|courriel)"
OTHER_USE = r"(?i)(version|licen[sc]e|cc |by-|page|chapter|no\.|token|password|key|sha|id)[^A-Za-z]*$"
BESIDE = r"(?i)\b(tel|phone|telephone|mobile|fax|call|contact|telefon|telefono|t[ée]l)[^A-Za-z0-9]{1,3}$"
DATE = r"^(?:(?:19|20)[0-9]{2}[./-][0-9]{1,2}[./-][0-9]{1,2}|[0-9]{1,2}[./-][0-9]{1,2}[./-](?:19|20)?[0-9]{2})$"
SHAPE = (r"^(?:(?:[0-9]{1,3}[\x20.-])?(?:\([0-9]{2,5}\)|[0-9]{2,5})[\x20./-]{1,2}[0-9]{3,4}[\x20.-]?[0-9]{3,4}"
         r"|0[1-9][0-9]{1,3}[/-][0-9]{5,8}|00[1-9][0-9]{8,12})$")
DOMAIN = rf"(?i)(?:\.|{DOT}\x20?|\x20dot\x20)[A-Za-z]{{2,}}$"
COVER = "array<struct<start:int,reach:int>>"


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out one time only, wherever the body uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def running(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """Every element joined by ``op`` with all before it: each round reaches twice as far back, so n elements take n log n steps."""
    def reach(acc: Column, far: Column) -> Column:
        return F.transform(acc, lambda x, i: F.when(i >= far, op(F.get(acc, (i - far).cast("int")), x)).otherwise(x))
    return once(values, lambda v: F.when(F.size(v) < 2, v).otherwise(F.aggregate(powers(F.size(v) - 1), v, reach)))


def powers(n: Column) -> Column:
    """1, 2, 4, ... up to n (1 at least)."""
    return F.transform(F.sequence(F.lit(0), F.floor(F.log2(n + 0.5)).cast("int")), lambda j: F.call_function("shiftleft", F.lit(1), j))


def last_before(spans: Column, limit: Column) -> Column:
    """The last of ``spans``, which are sorted by start, that starts before the limit (null: none), by halving."""
    def step(n: Column, far: Column) -> Column:
        return F.when(F.get(spans, n + far - 1)["start"] < limit, n + far).otherwise(n)
    n = F.aggregate(F.reverse(powers(F.size(spans))), F.lit(0), step)
    return F.when(F.size(spans) > 0, F.get(spans, n - 1))


def reaches(spans: Column) -> Column:
    """Of spans sorted by start: struct(start, reach), the reach being the largest end so far."""
    def of(spans: Column) -> Column:
        ends = running(F.transform(spans, lambda s: s["end"]), lambda a, b: F.greatest(a, b))
        return once(ends, lambda e: F.transform(spans, lambda s, i: F.struct(s["start"].alias("start"), F.get(e, i).alias("reach"))))
    return once(spans, of)


def apart(spans: Column) -> Column:
    """Of spans sorted by start, those that overlap none before them."""
    return once(spans, lambda spans: once(reaches(spans), lambda r: F.filter(spans, lambda s, i: (i == 0) | (s["start"] >= F.get(r, i - 1)["reach"]))))


def firsts(spans: Column, reach: Column) -> Column:
    """Places in ``spans`` (one at least, sorted by start) at which a cluster of overlapping ones begins."""
    return F.filter(F.sequence(F.lit(0), F.size(spans) - 1), lambda i: (i == 0) | (F.get(spans, i)["start"] >= F.get(reach, i - 1)["reach"]))


def merged(spans: Column) -> Column:
    """Clusters of overlapping spans, which are sorted by start, as struct(start, end, first), the first span's fields in ``first``."""
    def of(spans: Column, reach: Column) -> Column:
        return once(firsts(spans, reach), lambda at: F.transform(at, lambda i, j: F.struct(
            F.get(spans, i)["start"].alias("start"), F.get(reach, F.coalesce(F.get(at, j + 1), F.size(spans)) - 1)["reach"].alias("end"),
            F.get(spans, i).alias("first"))))
    return once(spans, lambda spans: F.when(F.size(spans) > 0, once(reaches(spans), lambda reach: of(spans, reach))))


def blocks_of(text: Column) -> Column:
    """The text in blocks of ``TEXT_BLOCK`` code points, so that ``piece`` needn't walk it from its start."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{TEXT_BLOCK}}}+"), F.lit(0))


def piece(blocks: Column, a: Column, b: Column) -> Column:
    """Code points ``a`` to ``b`` of a text in blocks."""
    def part(j: Column) -> Column:
        first = F.greatest(a - j * TEXT_BLOCK, F.lit(0))
        return F.substring(F.get(blocks, j), first + 1, F.least(b - j * TEXT_BLOCK, F.lit(TEXT_BLOCK)) - first)
    inside = F.sequence(F.floor(a / TEXT_BLOCK).cast("int"), F.floor((b - 1) / TEXT_BLOCK).cast("int"))
    return F.when(b > a, F.array_join(F.transform(inside, part), "")).otherwise("")


def replaced(text: Column, spans: Column) -> Column:
    """``text`` with each of the spans (struct(start, end, put), sorted, apart) as ``put``."""
    def joined(spans: Column, blocks: Column) -> Column:
        each = F.transform(spans, lambda s, i: F.concat(piece(blocks, F.when(i > 0, F.get(spans, i - 1)["end"]).otherwise(0), s["start"]), s["put"]))
        return F.concat(F.array_join(each, ""), piece(blocks, F.element_at(spans, -1)["end"], F.length(text)))
    return once(spans, lambda spans: F.when(F.size(spans) > 0, once(blocks_of(text), lambda blocks: joined(spans, blocks))).otherwise(text))


def with_places(docs: DataFrame, text: Column, patterns: dict[str, tuple[str, Column]]) -> DataFrame:
    """Adds a column for each name: all matches of its pattern as array of struct(hit, start, end, left, right).

    Matches and the gaps between them come from the same pattern, so lengths
    of both, added up, give the places.  Texts that fail the guard have none.
    """
    none = F.array().cast("array<string>")
    docs = docs.withColumns({f"_h_{n}": F.when(guard, F.regexp_extract_all(text, F.lit(p), F.lit(0))).otherwise(none)
                             for n, (p, guard) in patterns.items()})
    docs = docs.withColumns({f"_p_{n}": F.when(F.size(f"_h_{n}") > 0, F.split(text, p, -1)).otherwise(none) for n, (p, _) in patterns.items()})

    def places(n: str) -> Column:
        hits, gaps = F.col(f"_h_{n}"), F.col(f"_p_{n}")
        lengths = F.transform(hits, lambda hit, i: F.length(F.get(gaps, i)) + F.length(hit))

        def placed(ends: Column) -> Column:
            return F.transform(hits, lambda hit, i: F.struct(
                hit.alias("hit"), (F.get(ends, i) - F.length(hit)).alias("start"), F.get(ends, i).alias("end"),
                F.right(F.get(gaps, i), F.lit(CONTEXT)).alias("left"), F.left(F.get(gaps, i + 1), F.lit(CONTEXT)).alias("right")))
        return F.when(F.size(hits) > 0, once(running(lengths, lambda a, b: a + b), placed)).otherwise(F.array().cast(
            "array<struct<hit:string,start:int,end:int,left:string,right:string>>"))

    return docs.withColumns({n: places(n) for n in patterns}).drop(*[f"_{x}_{n}" for n in patterns for x in "hp"])


def digits_of(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def base_checks() -> list:
    part = lambda h, i: F.length(F.regexp_replace(F.split(h, r"\.")[i], "^0+(?=.)", "")) <= 3
    value = lambda h, i: F.right(F.split(h, r"\.")[i], F.lit(3)).cast("int") <= 255
    return [lambda h: F.lit(True),
            lambda h: reduce(lambda a, b: a & b, [part(h, i) & value(h, i) for i in range(4)]),
            lambda h: F.length(digits_of(h)).between(12, 19) & F.call_function("luhn_check", digits_of(h)),
            lambda h: F.length(digits_of(h)).between(9, 15)]


def with_base(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds ``_base``: the valid spans of the base kinds as struct(start, kind, end), sorted."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    guards = [F.contains(text, F.lit("@")), F.contains(text, F.lit(".")) & text.rlike("[0-9]"), text.rlike("[0-9][ -]?[0-9]"),
              F.contains(text, F.lit("+"))]
    found = {f"_f{k}": pair for k, pair in enumerate(zip((EMAIL, IP, CARD, PHONE), guards))}
    docs = with_places(docs, text, found)

    def valid(k: int, check) -> Column:
        return F.transform(F.filter(F.col(f"_f{k}"), lambda s: check(s["hit"])),
                           lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("kind"), s["end"].alias("end")))

    kinds = [valid(k, check) for k, check in enumerate(base_checks())]
    docs = docs.withColumn("_base", F.array_sort(F.concat(*kinds))).drop(*found)
    return docs.withColumn("_cover", F.when(F.size("_base") > 0, reaches(F.col("_base"))).otherwise(F.array().cast(COVER)))


def with_candidates(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds ``_cand``: candidate spans with kind and features, of all generators."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    spelled = F.contains(text, F.lit("@")) | text.rlike(r"(?i)[(\[{<]at[)\]}>]")
    made = {"_g0": (SPELLED, spelled), "_g1": (NUMBER, text.rlike("[0-9]")), "_g2": (TIGHT_SPELLED, spelled),
            "_g3": (TIGHT_NUMBER, text.rlike("[0-9]")), "_g4": (GROUPED, text.rlike("[0-9]{3}")), "_g5": (IN_WORDS, text.rlike("(?i) dot ")), "_g6": (SET_APART, text.rlike(r"[0-9] [._-] [0-9]"))}
    docs = with_places(docs, text, made)

    def described(s: Column) -> Column:
        hit, left, right, generator, groups = s["hit"], s["left"], s["right"], s["generator"], s["groups"]
        n = lambda chars: F.length(hit) - F.length(F.translate(hit, chars, ""))
        digits, dots = n("0123456789"), n(".")
        kind = F.when(generator == 0, 0).when((dots == 3) & (F.array_max(F.transform(groups, F.length)) <= 3), 1).when((digits >= 12) & ~hit.rlike("^00[1-9][0-9]{8,12}$"), 2).otherwise(3)
        octets = (F.size(groups) == 4) & ~F.exists(groups, lambda g: F.right(g, F.lit(9)).cast("int") > 255)
        # how long an address is and which digits its names have says nothing about it
        number = lambda x: F.when(generator == 0, 0).otherwise(x)
        made = [number(F.length(hit)), number(digits), number(F.length(F.regexp_replace(hit, "[^A-Za-z]", ""))), n("@"), dots, n(" "), n("-"), n("()"), n("+"),
                number(F.size(groups)), number(F.array_max(F.transform(groups, F.length))), number(F.array_min(F.transform(groups, F.length))),
                left.rlike("[A-Za-z0-9]$").cast("int"), left.rlike(r"[=\"':/#_-] ?$").cast("int"), right.rlike("^[A-Za-z0-9]").cast("int"),
                right.rlike(r"^[\"'/_-]").cast("int"), left.rlike(KEYWORDS).cast("int"), left.rlike(OTHER_USE).cast("int"),
                right.rlike(r"^\.?\s").cast("int"), generator,
                number(F.call_function("luhn_check", digits_of(hit)).cast("int")), hit.rlike(DOMAIN).cast("int"), hit.rlike(DATE).cast("int"),
                number(F.array_max(F.transform(groups, lambda g: F.right(g, F.lit(9)).cast("double")))),
                left.rlike(BESIDE).cast("int"), kind, F.when(kind == 1, octets).otherwise(hit.rlike(SHAPE)).cast("int")]
        return F.struct(s["start"].alias("start"), kind.alias("kind"), s["end"].alias("end"),
                        F.array(*[m.cast("double") for m in made]).alias("x"))

    def of(name: str, generator: int) -> Column:
        hits = F.filter(name, lambda s: F.length(digits_of(s["hit"])).between(5, MOST_DIGITS)) if generator else F.col(name)
        return F.transform(hits, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["hit"].alias("hit"), s["left"].alias("left"),
                                                    s["right"].alias("right"), F.lit(generator).alias("generator"),
                                                    F.filter(F.split(s["hit"], "[^0-9]+"), lambda g: g != "").alias("groups")))

    def differs(a: Column, b: Column) -> Column:
        return (a["start"] != b["start"]) | (a["end"] != b["end"]) | (a["generator"] != b["generator"])

    # a span that several generators propose is one candidate
    order = lambda a, b: F.when(differs(a, b), F.when((a["start"] < b["start"]) | (a["start"] == b["start"]) & (
        (a["end"] < b["end"]) | (a["end"] == b["end"]) & (a["generator"] < b["generator"])), -1).otherwise(1)).otherwise(0)
    hits = once(F.array_sort(F.concat(of("_g0", 0), of("_g2", 0), of("_g5", 0), of("_g1", 1), of("_g3", 1), of("_g4", 1), of("_g6", 1)), order),
                lambda all_: F.filter(all_, lambda s, i: (i == 0) | differs(s, F.get(all_, i - 1))))
    return docs.withColumn("_cand", F.transform(hits, described)).drop(*made)


FEATURES = 27
#: Forms of each base span in the calibration, and the least number of winners that a threshold must rest on.
CALIBRATION_WAYS, LEAST_WINNERS = 4, 20


@dataclass
class SpanModel:
    """Boosted trees of each kind as (kind, weight, nested tuples), and a threshold for each kind (None: it selects nothing)."""

    trees: list = field(default_factory=list)
    thresholds: list = field(default_factory=lambda: [None] * len(KINDS))

    def score(self, x: Column) -> Column:
        def value(tree: tuple) -> Column:
            if len(tree) == 1:
                return F.lit(tree[0])
            at, threshold, low, high = tree
            return F.when(x[at] <= threshold, value(low)).otherwise(value(high))
        none = F.lit(-9.0)  # a kind without trees
        margin = reduce(lambda c, k: c.when(x[25] == k, reduce(lambda a, b: a + b, [F.lit(w) * value(t) for j, w, t in self.trees if j == k])),
                        sorted({k for k, _, _ in self.trees}), F.when(F.lit(False), none)).otherwise(none)
        return 1 / (1 + F.exp(-2 * margin))

    def selects(self, cand: Column) -> Column:
        limit = reduce(lambda c, k: c.when(cand["kind"] == k, F.lit(self.thresholds[k] if self.thresholds[k] is not None else 2.0)),
                       range(1, len(KINDS)), F.when(cand["kind"] == 0, F.lit(self.thresholds[0] if self.thresholds[0] is not None else 2.0)))
        return self.score(cand["x"]) >= limit


def as_tuples(model: GBTClassificationModel) -> list:
    def walk(node) -> tuple:
        if node.getClass().getSimpleName() == "LeafNode":
            return (float(node.prediction()),)
        split = node.split()
        return (int(split.featureIndex()), float(split.threshold()), walk(node.leftChild()), walk(node.rightChild()))
    return [(float(w), walk(t._call_java("rootNode"))) for w, t in zip(model.treeWeights, model.trees)]


def masked(s: Column, unseen: bool = False) -> Column:
    """What stands for a base span in the training texts: struct(start, end, before, form, good) with the words before it, its new form, and whether that is personal.

    ``unseen``: the forms that thresholds are calibrated on, none of which the trees were fitted on.
    """
    hit, kind, d, way = s["hit"], s["kind"], s["digits"], s["way"]
    pick = lambda *forms: F.element_at(F.array(*forms), way + 1)
    t = F.lit
    local, host = F.substring_index(hit, "@", 1), F.substring_index(hit, "@", -1)
    label = F.substring_index(host, ".", 1)
    email = pick(F.concat(local, t("(at)"), host), F.concat(local, t(" (at) "), host),
                 F.concat(local, t("[at]"), F.replace(host, t("."), t("[dot]"))), F.concat(local, t(" at "), F.replace(host, t("."), t(" dot "))),
                 F.concat(local, t(" (at) "), label), F.concat(local, t("@"), label), F.concat(local, t("[at]"), label), F.concat(local, t(" @ "), label))
    spaced, boxed = F.replace(hit, t("."), t(". ")), F.replace(hit, t("."), t("[.]"))
    over = F.concat(t("7"), F.lpad(F.right(F.substring_index(hit, ".", 1), t(2)), 2, "0"), F.regexp_replace(hit, "^[0-9]+", ""))
    ip = pick(spaced, boxed, spaced, boxed, over, F.replace(over, t("."), t(". ")), over, F.replace(over, t("."), t("[.]")))
    wrong = F.concat(F.substring(d, t(1), F.length(d) - 1), ((F.right(d, t(1)).cast("int") + 1 + way) % 10).cast("string"))
    by_four = lambda x, sign: F.regexp_replace(x, "([0-9]{4})(?=[0-9])", "$1" + sign)
    card = pick(by_four(d, "."), by_four(d, "/"), by_four(d, "."), by_four(d, "/"), wrong, by_four(wrong, "-"), by_four(wrong, "."), by_four(wrong, "/"))
    apart = hit.rlike(r"^\+[0-9]{1,3}[^0-9]+[0-9]")
    home, plain = F.regexp_replace(hit, r"^\+[0-9]{1,3}[\x20.-]*", ""), F.right(d, t(10))
    sign = F.element_at(F.array(t("."), t("-"), t(" ")), F.pmod(F.xxhash64(hit, t(23)), t(3)).cast("int") + 1)
    parted = F.trim(F.regexp_replace(home, "[^0-9]+", sign), sign)
    date = lambda sign, *parts: F.concat_ws(sign, *parts)
    year, month, day = F.concat(t("20"), F.substring(d, 3, 2)), F.concat(t("0"), F.greatest(F.right(d, t(1)), t("1"))), F.concat(t("1"), F.substring(d, 4, 1))
    phone = pick(F.when(apart, F.substring(hit, t(2), F.length(hit))).otherwise(plain), F.when(apart, home).otherwise(plain),
                 F.when(apart, parted).otherwise(plain), plain, date("-", year, month, day), date("/", day, month, year), plain, F.right(d, t(8)))
    if unseen:
        spoken = lambda x: F.replace(x, t("."), t(" DOT "))
        email = pick(F.concat(local, t("{at}"), host), F.concat(local, t(" <at> "), F.replace(host, t("."), t(" <dot> "))),
                     F.concat(local, t(" AT "), spoken(host)), F.concat(local, t("{AT}"), F.replace(host, t("."), t("{DOT}"))),
                     F.concat(local, t("{at}"), label), F.concat(local, t(" <at> "), label), F.concat(local, t(" {AT} "), label), F.concat(local, t("(AT)"), label))
        wide, round_ = (lambda x: F.replace(x, t("."), t(" . "))), (lambda x: F.replace(x, t("."), t("(.)")))
        ip = pick(wide(hit), round_(hit), F.replace(hit, t("."), t("{.}")), wide(hit), wide(over), round_(over), F.replace(over, t("."), t("{.}")), wide(over))
        card = pick(*[by_four(x, sign) for x in (d, wrong) for sign in ("_", " - ", " . ", " _ ")])
        phone = pick(F.concat(t("00"), d), F.concat(t("0"), F.substring(d, 3, 3), t("/"), F.right(d, t(7))),
                     F.concat(t("0"), F.substring(d, 3, 3), t("-"), F.right(d, t(7))), F.concat(t("00"), d),
                     date(".", year, month, day), date(".", day, month, year), date("-", day, month, year), F.right(d, t(8)))
    before = F.when((F.lit(unseen)) & (kind == 3) & (way == 7), "chapter ").when(F.lit(unseen), "").when((kind == 3) & ((way == 3) | (way < 3) & ~apart), F.when(F.length(hit) % 2 == 0, "phone: ").otherwise("tel. ")).when((kind == 3) & (way == 7), "page ")
    form = F.when(kind == 0, email).when(kind == 1, ip).when(kind == 2, card).otherwise(phone)
    return F.struct(s["start"].alias("start"), s["end"].alias("end"), F.coalesce(before, t("")).alias("before"), form.alias("form"), (way < 4).alias("good"))


def labelled(docs: DataFrame, text_col: str = "text", ways: int = 1, unseen: bool = False) -> DataFrame:
    """``docs`` with masked base spans and ``_cand`` of them: struct(start, kind, end, x, label), label null where nothing is known.

    A document with base spans comes once for each of ``ways`` (8 at most), every time with other forms.
    Candidates that still touch a base span are left out, for they can't be added.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))

    def hit(s: Column, blocks: Column) -> Column:
        def described(found: Column) -> Column:
            return F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), found.alias("hit"), digits_of(found).alias("digits"),
                            F.pmod(F.xxhash64(found, F.lit(17)) + F.col("_way"), F.lit(8)).cast("int").alias("way"))
        return once(piece(blocks, s["start"], s["end"]), described)

    def put(forms: Column) -> Column:
        grown = F.transform(forms, lambda m: F.length(m["before"]) + F.length(m["form"]) - (m["end"] - m["start"]))

        def moved(after: Column) -> Column:
            def of(m: Column, i: Column) -> Column:
                start = m["end"] + F.get(after, i) - F.length(m["form"])
                return F.struct(start.alias("start"), (m["end"] + F.get(after, i)).alias("end"), m["good"].alias("good"))
            return F.transform(forms, of)
        return once(running(grown, lambda a, b: a + b), moved)

    docs = with_base(docs, text_col)
    docs = docs.withColumn("_way", F.explode_outer(F.sequence(F.lit(0), F.when(F.size("_base") > 0, ways - 1).otherwise(0))))
    hits = once(blocks_of(text), lambda blocks: F.transform(apart(F.col("_base")), lambda s: hit(s, blocks)))
    docs = docs.withColumn("_m", F.when(F.size("_base") > 0, F.transform(hits, lambda s: masked(s, unseen))))
    docs = docs.withColumn("_put", F.when(F.col("_m").isNotNull(), put(F.col("_m"))).otherwise(F.array().cast("array<struct<start:int,end:int,good:boolean>>")))
    spans = F.transform("_m", lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.concat(m["before"], m["form"]).alias("put")))
    docs = docs.withColumn(text_col, F.when(F.col("_m").isNotNull(), replaced(text, spans)).otherwise(text)).drop("_base", "_cover", "_way", "_m")
    docs = with_candidates(with_base(docs, text_col), text_col)

    def label(c: Column) -> Column:
        def of(p: Column) -> Column:
            x = c["x"]
            told = (c["kind"] > 0) & (x[24] == 1) & x[1].between(7, 15)
            formed = F.when(c["kind"] == 2, x[20] == 1).when(c["kind"] == 1, x[26] == 1).otherwise((x[26] == 1) & (x[22] == 0))
            unsure = F.when(c["kind"] == 0, x[21] == 1).otherwise(((x[16] == 1) | formed) & (x[17] == 0))
            same = p["good"] & (p["start"] == c["start"]) & (p["end"] == c["end"])
            return F.when(p["end"] > c["start"], same.cast("double")).when(told, 1.0).when(~unsure, 0.0)
        return once(last_before(F.col("_put"), c["end"]), of)

    free = F.filter("_cand", lambda c: ~touches_base(c))
    return docs.withColumn("_cand", F.transform(free, lambda c: F.struct(c["start"], c["kind"], c["end"], c["x"], label(c).alias("label"))))


def touches_base(c: Column) -> Column:
    return F.coalesce(last_before(F.col("_cover"), c["end"])["reach"] > c["start"], F.lit(False))


def winners(cands: Column) -> Column:
    """Of structs (rank, start, end, ...), least rank first: those that overlap none taken before.

    Spans are sorted by start and cut into clusters of overlapping ones; only within a cluster each is held against those taken.
    """
    def settled(cluster: Column) -> Column:
        def take(kept: Column, c: Column) -> Column:
            return F.when(F.exists(kept, lambda k: (k["start"] < c["end"]) & (k["end"] > c["start"])), kept).otherwise(F.concat(kept, F.array(c)))
        return F.when(F.size(cluster) < 2, cluster).otherwise(F.aggregate(F.array_sort(cluster), F.filter(cluster, lambda c: F.lit(False)), take))

    def clusters(swept: Column) -> Column:
        def cut_up(first: Column) -> Column:
            return F.flatten(F.transform(first, lambda i, j: once(F.slice(swept, i + 1, F.coalesce(F.get(first, j + 1), F.size(swept)) - i), settled)))
        starts = once(reaches(swept), lambda reach: firsts(swept, reach))
        return F.when(F.size(swept) < 2, swept).otherwise(once(starts, cut_up))

    return once(F.array_sort(cands, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["end"] - b["end"])), clusters)


def ranked(model: SpanModel, c: Column, *more: Column) -> Column:
    return F.struct((-model.score(c["x"])).alias("rank"), (c["start"] - c["end"]).alias("size"), c["start"].alias("start"), c["kind"].alias("kind"),
                    c["end"].alias("end"), *more)


def calibration(docs: DataFrame, model: SpanModel, text_col: str = "text") -> list:
    """Rows (kind, bin, good, n): the winners among candidates of even odds or more, by score in steps of 1/200; 4 kinds, 101 bins at most."""
    cands = F.filter(F.transform("_cand", lambda c: ranked(model, c, c["label"].alias("label"))), lambda c: c["rank"] <= -0.5)
    won = labelled(docs, text_col, ways=CALIBRATION_WAYS, unseen=True).withColumn("_won", cands).select(F.explode_outer(winners(F.col("_won"))).alias("c")).where("c.label is not null")
    return (won.groupBy("c.kind", F.floor(-F.col("c.rank") * 200).cast("int").alias("bin"))
            .agg(F.sum("c.label").alias("good"), F.count("*").alias("n")).collect())


def train(docs: DataFrame, sample_docs: int = 20_000, precision: float = 0.99, rounds: int = 8, depth: int = 3,
          id_col: str = "doc_id", text_col: str = "text") -> SpanModel:
    """Fits trees on 70% of about ``sample_docs`` documents, and thresholds on all other documents."""
    total = docs.count()
    if not total:
        return SpanModel()
    share = min(1.0, sample_docs / total)
    picked = docs.select(F.coalesce(F.xxhash64(id_col, F.lit(11)), F.lit(0)).alias("_h"), F.col(text_col).alias("text"))
    fitting = (F.pmod("_h", F.lit(1_000_003)) < int(share * 1_000_003)) & (F.pmod("_h", F.lit(10)) < 7)
    rows = (labelled(picked.where(fitting), ways=8).select(F.explode_outer("_cand").alias("c")).where("c.label is not null")
            .select(*[F.col("c.x")[i].alias(f"x{i}") for i in range(FEATURES)], F.col("c.label").alias("label")))
    rows = cut(rows.repartition(4))
    both = {r.x25 for r in rows.groupBy("x25").agg(F.countDistinct("label").alias("n")).where("n = 2").collect()}
    model = SpanModel()
    vectors = VectorAssembler(inputCols=[f"x{i}" for i in range(FEATURES)], outputCol="features").transform(rows)
    for kind in range(len(KINDS)):
        if kind in both:
            fitted = GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=0.3, seed=5, maxBins=32, cacheNodeIds=False).fit(
                vectors.where(F.col("x25") == kind).select("features", "label"))
            model.trees += [(kind, *t) for t in as_tuples(fitted)]
    if not model.trees:
        return model
    bins = calibration(picked.where(~fitting), model)
    for kind in range(len(KINDS)):
        good = n = 0.0
        for r in sorted((r for r in bins if r.kind == kind), key=lambda r: -r.bin):
            good, n = good + r.good, n + r.n
            if n >= LEAST_WINNERS and good / n >= precision and r.bin >= 100:  # and never below even odds
                model.thresholds[kind] = r.bin / 200
    return model


def find(docs: DataFrame, model: SpanModel, text_col: str = "text") -> DataFrame:
    """Adds ``base_spans`` and ``spans`` (base ones and the winners of the selected candidates that touch none), arrays of struct(start, kind, end)."""
    docs = with_candidates(with_base(docs, text_col), text_col)
    chosen = F.transform(F.filter("_cand", lambda c: ~touches_base(c) & model.selects(c)), lambda c: ranked(model, c))
    docs = docs.withColumn("_won", chosen)
    added = F.transform(winners(F.col("_won")), lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end")))
    return (docs.withColumn("spans", F.array_sort(F.concat("_base", added)))
            .withColumnRenamed("_base", "base_spans").drop("_cand", "_won", "_cover"))


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` by start, comma-joined."""
    name = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s["kind"]), s["start"], s["end"])), ",")


def redact(docs: DataFrame, model: SpanModel, text_col: str = "text") -> DataFrame:
    """The same columns, with every span replaced by its kind in brackets (a run of overlapping ones: by the first one's)."""
    held = own_names(docs, text_col)
    text = F.col(text_col)

    def tagged(s: Column) -> Column:
        tag = F.concat(F.lit("["), F.upper(F.element_at(F.array(*map(F.lit, KINDS)), s["first"]["kind"] + 1)), F.lit("]"))
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), tag.alias("put"))

    clean = replaced(text, F.transform(merged(F.col("spans")), tagged))
    redacted = find(held, model, text_col).withColumn(text_col, F.when(F.size("spans") > 0, clean).otherwise(text))
    return redacted.select(*held.columns).toDF(*docs.columns)
