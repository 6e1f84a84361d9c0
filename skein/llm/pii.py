"""Personal data: validated patterns, and boosted trees over wider candidates. DataFrame and SQL functions only.

Base spans are found by patterns and checks (address parts, Luhn, number of digits). For the rest, generators of high recall
propose overlapping candidates: anything around an at sign, runs of digits and separators of any length, with and without blanks,
long mixed tokens, and values given to names such as password or token. Those of which the base patterns leave no letter or digit are
settled already. Gradient-boosted trees score the others by format and context, and a threshold for each kind, calibrated on
held-out examples for high precision, selects spans; of these only such as lie within another are left out. The trees are trained
once for each application on examples that SQL makes from templates and hashes, so no labels are needed, and then written as one
expression, so that all of it is a projection of a row's text: no join, shuffle or table.

Patterns are written so that no text makes them backtrack or recurse: repeated groups are first reduced to single marks of the
same length, and runs start only where a run can start. Offsets are running sums over the pieces between matches, and texts are
put together from pieces, so the time is in proportion to a text's length.

Defined cases: null and empty texts have no spans; repeated rows have the same result each; an empty table gives no rows;
columns other than doc_id and text are not read, and redact() returns them as they are, whatever their names. Offsets count code points.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.strings import let
from skein.session import drop, materialize

BASE_KINDS = ["email", "ip", "card", "phone"]
#: Kinds that only the trees select.
MORE_KINDS = ["contact", "number", "secret"]
KINDS = BASE_KINDS + MORE_KINDS
CONTEXT = 24
AFTER = 4
EXAMPLES = 8000
PRECISION = 0.99

MARK, OTHER = "\u0001", "\u0002"
LOCAL = r"A-Za-z0-9._%+\x01-"
EMAIL = rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++\x01[A-Za-z0-9\x01-]++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9][0-9\x01]++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
CONTACT_LIKE = r"(?:\G|(?<![^\s@<>,;]))[^\s@<>,;]++@[^\s@<>,;]++"
NUMBER_LIKE = r"(?<![0-9])[+(]?[0-9][0-9 ()./-]{4,}[0-9](?![0-9])"
#: The same without blanks, for numbers within long rows of numbers.
COMPACT = r"(?<![0-9().\/-])[+(]?[0-9][0-9()./-]{4,}[0-9](?![0-9])"
#: A named value in quotes, words behind "passphrase", another named value, or a long mixed token.
SECRET_LIKE = r"(?i)(?:password|passwd|pwd|passphrase|secret) ?[=:] ?\"[^\"\n]{6,80}+\"|passphrase ?[=:] ?[a-z]++(?: [a-z]++){2,7}|(?:password|passwd|pwd|passphrase|token|secret|api[_-]?key) ?[=:] ?\"?[^\s\"]{6,}+\"?|(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])[A-Za-z0-9+/_=-]{16,}+"
NAMED = "(?i)password|passwd|pwd|passphrase|token|secret|api[_-]?key"
#: Words ahead of numbers and tokens that are public.
REFERENCE = "isbn|issn|doi|arxiv|commit|revision|sha|md5|hash|checksum|digest|uuid|guid|version|release|build|issue|ticket|order|invoice|page|year|chapter|section|model|figure|table|rfc"
SPANS = "array<struct<start:int,end:int,kind:int>>"


def running(xs: Column, op: Callable[[Column, Column], Column], zero: int = 0) -> Column:
    """array<int>: op over the elements before each one, and over all at the end. Grown in short arrays, as appending copies."""
    ints = F.array().cast("array<int>")
    start = F.struct(F.lit(zero).alias("at"), ints.alias("part"), F.array().cast("array<array<int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        full = F.size(acc["part"]) >= 64
        return F.struct(
            op(acc["at"], x).cast("int").alias("at"), F.when(full, F.array(acc["at"])).otherwise(F.array_append(acc["part"], acc["at"])).alias("part"),
            F.when(full, F.array_append(acc["out"], acc["part"])).otherwise(acc["out"]).alias("out"),
        )

    return F.aggregate(xs, start, step, lambda acc: F.array_append(F.flatten(F.array_append(acc["out"], acc["part"])), acc["at"]))


def found(text: Column, pattern: str, when: Column) -> Column:
    """array<struct<start,end,text,before,after>> of all matches; before: what stands ahead of it, from the match before on at most; after: a few characters behind it."""
    cut = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda a, m: F.struct(a.alias("gap"), m.alias("match")))

    def spans(parts: Column) -> Column:
        ends = running(F.transform(parts, lambda p: F.length(p["gap"]) + F.coalesce(F.length(p["match"]), F.lit(0))), lambda a, b: a + b)
        before = lambda p, i: F.lower(F.right(F.concat(F.coalesce(F.try_element_at(parts, F.greatest(i, F.lit(1)))["match"], F.lit("")), p["gap"]), F.lit(CONTEXT)))
        heads = F.transform(parts, lambda p, i: F.struct(p["gap"].alias("gap"), p["match"].alias("match"), F.when(i > 0, before(p, i)).otherwise(F.lower(F.right(p["gap"], F.lit(CONTEXT)))).alias("before"), F.left(F.coalesce(F.try_element_at(parts, i + 2)["gap"], F.lit("")), F.lit(AFTER)).alias("after")))
        each = F.zip_with(heads, ends, lambda p, at: F.struct((at + F.length(p["gap"])).alias("start"), (at + F.length(p["gap"]) + F.length(p["match"])).alias("end"), p["match"].alias("text"), p["before"].alias("before"), p["after"].alias("after")))
        return F.filter(each, lambda s: s["text"].isNotNull())

    return F.when(when, let(cut, spans)).otherwise(F.array().cast("array<struct<start:int,end:int,text:string,before:string,after:string>>"))


def only_digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn_sum(digits: Column) -> Column:
    """Of a string of digits, as if a check digit were its last."""
    r = F.reverse(digits)

    def one(i: Column) -> Column:
        d = F.substring(r, i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(digits))), F.lit(0), lambda acc, i: acc + F.coalesce(one(i), F.lit(0)))


def passes(kind: str, s: Column) -> Column:
    d = only_digits(s)
    if kind == "ip":
        return ~F.exists(F.split(s, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) > 3) | (F.coalesce(F.when(F.length(F.ltrim(p, F.lit("0"))) <= 3, p.substr(-3, 3).cast("int")), F.lit(999)) > 255))
    if kind == "card":
        return F.when(F.length(d).between(14, 19), luhn_sum(d) % 10 == 0).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(d).between(10, 15)
    return F.lit(True)


def mail_marks(t: Column) -> Column:
    return F.regexp_replace(t, r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", MARK)


def run_marks(t: Column) -> Column:
    return F.regexp_replace(t, "(?<=[0-9])[ -](?=[0-9])", MARK)


def rest_of(text: Column) -> Column:
    """A candidate without what the base patterns find in it."""

    def without(text: Column, pattern: str, kind: str) -> Column:
        left = lambda a, m: F.concat(a, F.when(passes(kind, m), F.lit(" ")).otherwise(F.coalesce(m, F.lit(""))))
        return let(text, lambda t: F.array_join(F.zip_with(F.split(t, pattern, -1), F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), left), ""))

    out = without(mail_marks(text), EMAIL, "email")
    for kind, pattern in (("phone", PHONE), ("ip", IP)):
        out = without(F.translate(out, MARK, "."), pattern, kind)
    return without(run_marks(out), CARD, "card")


def free_prefix(columns: list[str]) -> str:
    """What no column's name starts with, whatever its case."""
    p = "_pii"
    while any(c.lower().startswith(p) for c in columns):
        p += "_"
    return p


def with_spans(df: DataFrame, p: str) -> DataFrame:
    """Adds {p}base, array<struct<start,end,kind>> of checked spans, and {p}cands, those of the generators that are more than base spans."""
    name = lambda x: f"{p}{x}"
    at = lambda x: F.col(name(x))
    df = df.withColumn(name("t"), F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), MARK, OTHER))
    df = df.withColumns({name("has_at"): at("t").contains("@"), name("has_digit"): at("t").rlike("[0-9]")})
    df = df.withColumns({name("mail"): F.when(at("has_at"), mail_marks(at("t"))), name("run"): F.when(at("has_digit"), run_marks(at("t")))})
    base = {"email": ("mail", EMAIL, at("has_at")), "ip": ("t", IP, at("has_digit")), "card": ("run", CARD, at("has_digit")), "phone": ("t", PHONE, at("t").contains("+"))}
    df = df.withColumns({name(k): found(at(c), pattern, w) for k, (c, pattern, w) in base.items()})

    def checked(kind: str) -> Column:
        return F.transform(F.filter(at(kind), lambda s: passes(kind, s["text"])), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(BASE_KINDS.index(kind)).alias("kind")))

    df = df.withColumn(name("base"), F.array_sort(F.concat(*[checked(k) for k in BASE_KINDS])))
    wide = [("contact", CONTACT_LIKE, at("has_at")), ("number", NUMBER_LIKE, at("has_digit")), ("number", COMPACT, at("has_digit")), ("secret", SECRET_LIKE, at("has_digit") | at("t").rlike(NAMED))]

    def proposed(kind: str, pattern: str, when: Column) -> Column:
        free = F.filter(found(at("t"), pattern, when), lambda s: rest_of(s["text"]).rlike(r"[\pL\pN]"))
        return F.transform(free, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(KINDS.index(kind)).alias("kind"), s["text"].alias("text"), s["before"].alias("before"), s["after"].alias("after")))

    df = df.withColumn(name("cands"), F.concat(*[proposed(*w) for w in wide]))
    return df.drop(*[name(x) for x in ("t", "has_at", "has_digit", "mail", "run", *BASE_KINDS)])


def features(c: Column) -> dict[str, Column]:
    """Format and context of a candidate."""
    s, before, n = c["text"], c["before"], F.length(c["text"]).cast("double")
    size = lambda p: F.length(F.regexp_replace(s, p, "")).cast("double")
    digits, upper, lower = size("[^0-9]"), size("[^A-Z]"), size("[^a-z]")
    flag = lambda x: F.coalesce(x, F.lit(False)).cast("double")
    groups = F.transform(F.regexp_extract_all(s, F.lit("[0-9]+"), F.lit(0)), F.length)
    of_groups = lambda x: F.coalesce(x, F.lit(0)).cast("double")
    return {
        **{f"is_{k}": flag(c["kind"] == KINDS.index(k)) for k in MORE_KINDS},
        "size": n,
        "digits": digits,
        "upper": upper,
        "lower": lower,
        "other": n - digits - upper - lower,
        "digit_share": digits / n,
        "hex_share": size("[^0-9a-f]") / n,
        "changes": F.size(F.regexp_extract_all(s, F.lit("[0-9]+|[A-Z]+|[a-z]+"), F.lit(0))).cast("double"),
        "separators": size("[^ ()./-]"),
        "groups": of_groups(F.size(groups)),
        "first_group": of_groups(F.try_element_at(groups, F.lit(1))),
        "last_group": of_groups(F.try_element_at(groups, F.lit(-1))),
        "longest_group": of_groups(F.array_max(groups)),
        "shortest_group": of_groups(F.array_min(groups)),
        "local": flag(s.rlike(r"^\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}$")),
        "social": flag(s.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$")),
        "abroad": flag(s.rlike("^00[1-9]?")),
        "slash": flag(s.contains("/")),
        "decimal": flag(s.rlike(r"^[0-9]+\.[0-9]+$")),
        "years": flag(s.rlike(r"^(19|20)[0-9]{2} ?- ?(19|20)[0-9]{2}$")),
        "book": flag(s.rlike(r"^97[89][- ]?[0-9]")),
        "uuid": flag(s.rlike(r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")),
        "card": flag(let(only_digits(s), lambda d: F.length(d).between(14, 19) & (luhn_sum(d) % 10 == 0))),
        "glued": flag(before.rlike(r"[\pL\pN_/=.?&#@%~-]$")),
        "in_link": flag(before.rlike(r"[/?&]\S*$")),
        "runs_on": flag(c["after"].rlike(r"^[\pL\pN_/@%~-]")),
        "says_ref": flag(before.rlike(REFERENCE)),
        "starts_plus": flag(s.startswith("+")),
        "starts_key": flag(s.rlike("^(AKIA|ASIA|ghp_|sk-|xox)")),
        "named": flag(s.rlike("(?i)^(password|passwd|pwd|passphrase|token|secret|api[_-]?key)")),
        "domain": flag(s.rlike(r"@[^@]+\.[A-Za-z]{2,}")),
        "date": flag(s.rlike(r"^(19|20)[0-9]{2}[-/.][0-9]{1,2}[-/.][0-9]{1,2}$")),
        "says_secret": flag(before.rlike("pass|token|secret|key|auth|credential")),
        "says_call": flag(before.rlike("tel|phone|call|mobile|fax|contact|reach")),
        "says_card": flag(before.rlike("card|visa|account|acct|iban|credit|ssn|social")),
        "says_mail": flag(before.rlike("mail|contact|write|reach")),
    }


def examples(spark: SparkSession, n: int = EXAMPLES) -> DataFrame:
    """Made sentences (text), where a private item stands in it (a, b; empty if none), and label."""
    num = lambda k, size: F.lpad(F.pmod(F.xxhash64("id", F.lit(k)), F.lit(10**size)).cast("string"), size, "0")
    hexed = lambda k: F.lower(F.lpad(F.hex(F.xxhash64("id", F.lit(k))), 16, "0"))
    word = lambda k, size: F.substring(F.translate(hexed(k), "0123456789", "ghijklmnop"), 1, size)
    caps = lambda k, size: F.substring(F.translate(F.upper(F.concat(hexed(k), hexed(k + 1))), "01", "XY"), 1, size)
    pick = lambda k, *xs: F.element_at(F.array(*map(F.lit, xs)), F.pmod(F.xxhash64("id", F.lit(-k)), F.lit(len(xs))).cast("int") + 1)
    body = F.concat(F.lit("4"), num(1, 14))
    card = F.concat(body, F.pmod(10 - luhn_sum(F.concat(body, F.lit("0"))) % 10, F.lit(10)).cast("string"))
    lit, cat = F.lit, F.concat
    good = [
        cat(word(1, 6), lit("."), num(2, 2), lit("@"), word(3, 8), lit("."), word(4, 3)),
        cat(word(1, 5), lit("_"), word(2, 4), lit("@["), num(3, 2), lit(".8.7.6]")),
        cat(word(1, 7), lit("@"), word(2, 9), lit("_x.com")),
        cat(lit("("), num(1, 3), lit(") "), num(2, 3), lit("-"), num(3, 4)),
        cat(num(1, 3), lit("-"), num(2, 3), lit("-"), num(3, 4)),
        cat(lit("00"), num(1, 2), lit(" "), num(2, 4), lit(" "), num(3, 6)),
        cat(num(1, 3), lit("-"), num(2, 2), lit("-"), num(3, 4)),
        cat(F.substring(card, 1, 4), lit("."), F.substring(card, 5, 4), lit("."), F.substring(card, 9, 4), lit("."), F.substring(card, 13, 4)),
        cat(lit("AKIA"), caps(1, 16)),
        cat(lit('token = "'), hexed(1), hexed(2), F.substring(hexed(3), 1, 8), lit('"')),
        cat(lit("password="), hexed(1), F.substring(hexed(2), 1, 2)),
        cat(lit("api_key: "), caps(1, 24)),
        cat(lit("secret="), word(1, 6), num(2, 4)),
        cat(pick(5, "key ", "secret key ", "auth ", "token ", "credential "), hexed(1), hexed(2), F.substring(hexed(3), 1, 8)),
        cat(lit('password: "'), word(1, 5), lit(" "), word(2, 4), lit(" "), word(3, 6), lit('"')),
        cat(lit("passphrase: "), word(1, 5), lit(" "), word(2, 4), lit(" "), word(3, 6), lit(" "), word(4, 5)),
        cat(card, lit(" "), card),
    ]
    bad = [
        cat(lit("@"), word(1, 7)),
        cat(word(1, 3), lit("@"), word(2, 4)),
        cat(lit("v"), num(1, 1), lit("."), num(2, 2), lit("."), num(3, 3)),
        cat(lit("20"), num(1, 2), lit("-"), num(2, 2), lit("-"), num(3, 2)),
        cat(lit("1"), num(1, 1), lit(" "), num(2, 3), lit(" "), num(3, 3)),
        cat(num(1, 1), lit(" "), num(2, 1), lit(" "), num(3, 1), lit(" "), num(4, 1), lit(" "), num(5, 1)),
        cat(num(1, 3), lit(" - "), num(2, 4)),
        cat(num(1, 2), lit("/"), num(2, 2), lit("/20"), num(3, 2)),
        cat(word(1, 16), num(2, 2)),
        cat(word(1, 9), lit("-"), word(2, 8), lit("-"), num(3, 2)),
        cat(F.initcap(word(1, 14)), num(2, 3)),
        cat(lit("/"), word(1, 8), lit("/"), num(2, 4), lit("/"), word(3, 6)),
        num(1, 16),
        num(1, 12),
        cat(num(1, 12), num(2, 8)),
        cat(lit("token "), word(1, 9)),
        cat(num(1, 1), lit(")  ("), num(2, 1), lit("."), num(3, 2), lit(").")),
        # what is public: links, books, papers, commits, sums, versions, years, numbers of things
        cat(lit("https://"), word(1, 7), lit(".org/"), word(2, 3), lit("/20"), num(3, 2), lit("/"), num(4, 2), lit("/"), num(5, 5)),
        cat(lit("https://"), word(1, 6), lit(".com/"), num(2, 4), lit("-"), num(3, 3), lit("-"), num(4, 4), lit("?id="), num(5, 9), lit("&k="), hexed(6)),
        cat(lit("www."), word(1, 6), lit(".net/"), hexed(2), lit("/"), num(3, 3), lit("-"), num(4, 3), lit("-"), num(5, 4)),
        cat(pick(6, "ISBN ", "isbn: ", ""), lit("978-"), num(1, 1), lit("-"), num(2, 2), lit("-"), num(3, 6), lit("-"), num(4, 1)),
        cat(pick(6, "ISBN ", "ISSN ", "isbn "), num(1, 1), lit("-"), num(2, 4), lit("-"), num(3, 4), lit("-"), num(4, 1)),
        cat(pick(6, "commit ", "revision ", "sha1 ", "hash "), hexed(1), hexed(2), F.substring(hexed(3), 1, 8)),
        cat(pick(6, "md5 ", "checksum ", "digest: "), hexed(1), hexed(2)),
        cat(hexed(1), hexed(2), F.substring(hexed(3), 1, 8)),
        cat(pick(6, "id ", "uuid ", ""), *[cat(lit(d), F.substring(cat(hexed(4), hexed(5)), k, n)) for d, k, n in (("", 1, 8), ("-", 9, 4), ("-", 13, 4), ("-", 17, 4), ("-", 20, 12))]),
        cat(pick(6, "id ", "uuid ", ""), num(1, 8), lit("-"), num(2, 4), lit("-4"), num(3, 3), lit("-a"), num(4, 3), lit("-"), num(5, 12)),
        cat(pick(6, "doi ", "doi:", "DOI: ", ""), lit("10."), num(1, 4), lit("/"), num(2, 3), lit("."), num(3, 4), lit("."), num(4, 2)),
        cat(pick(6, "arXiv ", "arXiv:", ""), num(1, 4), lit("."), num(2, 5)),
        cat(lit("19"), num(1, 2), pick(6, "-", " - "), lit("20"), num(2, 2)),
        cat(num(1, 1), lit("."), num(2, 9), num(3, 5)),
        cat(pick(6, "order ", "invoice ", "ticket "), lit("20"), num(1, 2), lit("-"), num(2, 6), lit("-"), num(3, 2)),
        cat(pick(6, "issue ", "page ", "build ", ""), num(1, 8)),
        cat(pick(6, "version ", "release ", ""), num(1, 1), lit("."), num(2, 2), lit("."), num(3, 2), lit("."), num(4, 5)),
        cat(lit("20"), num(1, 2), lit("-"), num(2, 2), lit("-"), num(3, 2), lit(" "), num(4, 2), lit(":"), num(5, 2)),
    ]
    which = F.pmod(F.xxhash64("id", F.lit(-1)), F.lit(len(good) + len(bad))).cast("int")
    hint = F.element_at(F.array(*map(lit, ["", "", "", "call ", "my card ", "mail ", "key ", "phone: "])), F.pmod(F.xxhash64("id", F.lit(-2)), F.lit(8)).cast("int") + 1)
    d = spark.range(n).withColumn("item", F.element_at(F.array(*good, *bad), which + 1)).withColumn("label", (which < len(good)).cast("int"))
    lead = cat(word(11, 9), lit(" "), word(12, 4), lit(" "), F.when(F.col("label") == 1, hint).otherwise(F.when(F.col("id") % 7 == 0, hint).otherwise("")))
    d = d.withColumn("lead", lead).withColumn("text", cat("lead", "item", lit(" "), word(13, 6), lit(" "), word(14, 5), lit(".")))
    return d.select("id", "label", "text", F.length("lead").alias("a"), (F.length("lead") + F.length("item")).alias("b"))


_trained: dict[str, tuple[Callable[[Column], Column], list[float]]] = {}


def _as_column(model, names: list[str]) -> Callable[[Column], Column]:
    """The trees' probability as an expression over a struct of features."""

    def node(n, f: Column) -> Column:
        if n.subtreeDepth() == 0:
            return F.lit(float(n.prediction()))
        split = n.split()
        return F.when(f[names[split.featureIndex()]] <= F.lit(float(split.threshold())), node(n.leftChild(), f)).otherwise(node(n.rightChild(), f))

    def probability(f: Column) -> Column:
        total = sum((F.lit(float(w)) * node(t._call_java("rootNode"), f) for w, t in zip(model.treeWeights, model.trees, strict=True)), F.lit(0.0))
        return 1 / (1 + F.exp(-2 * total))

    return probability


def calibrated(scored: list[tuple[float, float]], precision: float = PRECISION) -> float:
    """The lowest threshold of (probability, label) pairs at which the share of positives among those above reaches the precision; 1.01 if none does."""
    scored = sorted(scored, reverse=True)
    cut, good = 1.01, 0.0
    for i, (p, y) in enumerate(scored, 1):
        good += y
        if good >= precision * i and (i == len(scored) or scored[i][0] < p):
            cut = p
    return cut


def trained(spark: SparkSession) -> tuple[Callable[[Column], Column], list[float]]:
    """The trees as an expression, and a threshold for each of MORE_KINDS; made once for each application."""
    key = spark.sparkContext.applicationId
    if key not in _trained:
        from pyspark.ml.classification import GBTClassifier
        from pyspark.ml.feature import VectorAssembler

        made = materialize(examples(spark), "pii-sentences")  # else every use of the text would make it anew
        rows = with_spans(made, "_").select("id", "label", "a", "b", F.explode("_cands").alias("c"))
        common = F.least("c.end", "b") - F.greatest("c.start", "a")
        hit = common > 0
        # a piece of an item is no example of either kind
        rows = rows.where(~hit | (F.col("label") == 0) | (common >= 0.7 * (F.col("b") - F.col("a")))).select("id", F.col("c.kind").alias("kind"), (hit & (F.col("label") == 1)).cast("double").alias("label"), *[v.alias(k) for k, v in features(F.col("c")).items()])
        rows = materialize(rows, "pii-examples")
        names = [c for c in rows.columns if c not in ("id", "label", "kind")]
        data = VectorAssembler(inputCols=names, outputCol="features").transform(rows.where("id % 3 != 0"))
        p = _as_column(GBTClassifier(maxIter=20, maxDepth=4, stepSize=0.3, seed=7, labelCol="label").fit(data), names)
        held = rows.where("id % 3 = 0").select("kind", p(F.struct(*names)).alias("p"), "label").collect()  # a third of EXAMPLES
        _trained[key] = p, [calibrated([(r["p"], r["label"]) for r in held if r["kind"] == KINDS.index(k)]) for k in MORE_KINDS]
        drop(made, rows)
    return _trained[key]


def kept(cands: Column) -> Column:
    """Of array<struct<start,n,p,kind,end>>, sorted, with n = start - end and p negative, those that do not lie within one before; of equal spans the surest."""
    reach = running(F.transform(cands, lambda s: s["end"]), F.greatest, -1)
    both = F.zip_with(cands, reach, lambda s, r: F.struct(s.alias("s"), r.alias("r")))
    some = F.filter(both, lambda x: x["s"].isNotNull() & (x["s"]["end"] > x["r"]))
    return F.transform(some, lambda x: F.struct(x["s"]["start"].alias("start"), x["s"]["end"].alias("end"), x["s"]["kind"].alias("kind"))).cast(SPANS)


def with_selected(df: DataFrame, p: str) -> DataFrame:
    """Adds {p}base and {p}spans, array<struct<start,end,kind>>: the base ones and those that the trees select."""
    probability, cuts = trained(df.sparkSession)
    df = with_spans(df, p)

    def scored(c: Column) -> Column:
        f = F.struct(*[v.alias(k) for k, v in features(c).items()])
        odds = let(f, probability)
        return F.struct(c["start"].alias("start"), (c["start"] - c["end"]).alias("n"), (-odds).alias("p"), c["kind"].alias("kind"), c["end"].alias("end"))

    limit = lambda s: F.element_at(F.array(*map(F.lit, cuts)), s["kind"] - len(BASE_KINDS) + 1)
    sure = F.array_sort(F.filter(F.transform(f"{p}cands", scored), lambda s: -s["p"] >= limit(s)))
    df = df.withColumn(f"{p}sure", sure)
    df = df.withColumn(f"{p}spans", F.array_sort(F.concat(f"{p}base", F.when(F.size(f"{p}sure") > 0, kept(F.col(f"{p}sure"))).otherwise(F.array().cast(SPANS)))))
    return df.drop(f"{p}cands", f"{p}sure")


def digest(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed; comma-joined."""
    by = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(by, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def private_spans(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256, spans."""
    s = with_selected(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "_")
    kinds = F.transform("_base", lambda x: x["kind"])
    return s.select(
        "doc_id", *[(F.size("_base") - F.size(F.array_remove(kinds, i))).cast("long").alias(f"n_{k}") for i, k in enumerate(BASE_KINDS)],
        F.sha2(digest(F.col("_base")), 256).alias("base_sha256"), digest(F.col("_spans")).alias("spans"),
    )


#: Code points of a piece of text that redaction cuts from.
PIECE = 512


def redacted(text: Column, spans: Column) -> Column:
    """text with [kind] in place of every run of overlapping spans (sorted), named by its first one."""
    names = F.array(*map(F.lit, KINDS))

    def between(pieces: Column, a: Column, b: Column) -> Column:
        """The text from a to b."""
        first = F.floor(a / PIECE).cast("int")
        some = F.slice(pieces, first + 1, F.greatest(F.lit(0), F.ceil(b / PIECE).cast("int") - first))
        inside = lambda x, i: F.substring(x, F.greatest(F.lit(0), a - (first + i) * PIECE) + 1, F.least(F.lit(PIECE), b - (first + i) * PIECE) - F.greatest(F.lit(0), a - (first + i) * PIECE))
        return F.when(b > a, F.array_join(F.transform(some, inside), "")).otherwise(F.lit(""))

    def put(pieces: Column) -> Column:
        n = F.length(text)
        ended = F.concat(spans, F.array(F.struct(n.alias("start"), n.alias("end"), F.lit(-1).alias("kind"))))
        both = F.zip_with(ended, running(F.transform(spans, lambda s: s["end"]), F.greatest), lambda s, r: F.struct(s.alias("s"), r.alias("r")))
        heads = F.filter(both, lambda x: (x["s"]["start"] >= x["r"]) | (x["s"]["kind"] < 0))
        name = lambda s: F.when(s["kind"] >= 0, F.concat(F.lit("["), F.element_at(names, s["kind"] + 1), F.lit("]"))).otherwise(F.lit(""))
        return F.array_join(F.transform(heads, lambda x: F.concat(between(pieces, x["r"], x["s"]["start"]), name(x["s"]))), "")

    return let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)), put)


def redact(docs: DataFrame) -> DataFrame:
    """All rows and columns, with [kind] in place of every selected span of text; overlapping spans are replaced together."""
    p = free_prefix(docs.columns)
    d = with_selected(docs, p)
    d = d.withColumn("text", F.when(F.size(f"{p}spans") > 0, redacted(F.col("text"), F.col(f"{p}spans"))).otherwise(F.col("text")))
    return d.drop(f"{p}base", f"{p}spans")
