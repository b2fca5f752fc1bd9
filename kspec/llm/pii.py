"""Personal data in texts, by DataFrame functions only.

Regular expressions propose spans. Validators confirm them: Luhn for cards, mod-97 for IBANs and French numbers, a letter by mod-23 for Spanish ones, mod-11 for British and German
ones, entropy for keys and secrets, ranges and digit counts for the rest. Words nearby raise or lower a span's score. Spans of the base kinds stay whatever their score; spans of the
added kinds need at least `threshold`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("iban", "ssn", "tel", "dni", "nir", "nhs", "idnr", "key", "secret")

#: The same matches as the plain patterns find. Possessive repeats need no stack however long a match is, and the looks behind keep a long run without a match from being tried at each of its characters.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=(?:\x20?[A-Z0-9]){11})",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "tel": r"(?<![0-9+-])(?:\([0-9]{3}\)\x20|[0-9]{3}[\x20-])[0-9]{3}-[0-9]{4}(?![0-9-])",
    "dni": r"(?<![A-Za-z0-9])[0-9XYZ][0-9]{7}-?[A-Z](?![A-Za-z0-9])",
    "nir": r"(?<![0-9])[12]\x20?[0-9]{2}\x20?(?:0[1-9]|1[0-2])\x20?[0-9]{2}\x20?[0-9]{3}\x20?[0-9]{3}\x20?[0-9]{2}(?![0-9])",
    "nhs": r"(?<![0-9-])[0-9]{3}[\x20-]?[0-9]{3}[\x20-]?[0-9]{4}(?![0-9-])",
    "idnr": r"(?<![0-9])[1-9][0-9]\x20?[0-9]{3}\x20?[0-9]{3}\x20?[0-9]{3}(?![0-9])",
    "key": r"(?<![A-Za-z0-9_-])(?:AKIA[0-9A-Z]{16}(?![A-Za-z0-9])|gh[pousr]_[A-Za-z0-9]{36,}+|xox[abprs]-[A-Za-z0-9-]{10,}+|AIza[A-Za-z0-9_-]{35}|sk_live_[A-Za-z0-9]{16,}+|eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+)",
    "secret": r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}+={0,2}(?![A-Za-z0-9+/_=-])",
}
#: Where a proposed IBAN (the pattern finds its first four characters) may go on to, and the lengths that countries have fixed.
IBAN_CHARS = r"^[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}"
IBAN_LENGTHS = dict(x.split(":") for x in (
    "NO:15 BE:16 DK:18 FI:18 FK:18 FO:18 GL:18 NL:18 SD:18 MK:19 SI:19 AT:20 BA:20 EE:20 KZ:20 LT:20 LU:20 MN:20 XK:20 CH:21 HR:21 LI:21 LV:21 BG:22 BH:22 CR:22 DE:22 GB:22 GE:22 IE:22 ME:22 RS:22 VA:22 "
    "AE:23 GI:23 IL:23 IQ:23 OM:23 SO:23 TL:23 AD:24 CZ:24 ES:24 MD:24 PK:24 RO:24 SA:24 SE:24 SK:24 TN:24 VG:24 LY:25 PT:25 ST:25 IS:26 TR:26 BI:27 DJ:27 FR:27 GR:27 IT:27 MC:27 MR:27 SM:27 "
    "AL:28 AZ:28 BY:28 CY:28 DO:28 GT:28 HN:28 HU:28 LB:28 NI:28 PL:28 SV:28 BR:29 EG:29 PS:29 QA:29 UA:29 JO:30 KW:30 MU:30 YE:30 MT:31 SC:31 LC:32 RU:33"
).split())
#: What a text must hold for the pattern to match at all.
NEEDS = {"email": "@", "ip": ".", "phone": "+", "ssn": "-"}
#: Score of a span of each kind once its validator has confirmed it.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.9, "phone": 0.7, "iban": 0.9, "ssn": 0.4, "tel": 0.3, "dni": 0.6, "nir": 0.8, "nhs": 0.3, "idnr": 0.3, "key": 0.9, "secret": 0.4}
CONTEXT = {
    "email": "mail|contact|write|kontakt|correo|courriel",
    "ip": "ip|address|host|server|adresse",
    "card": "card|visa|credit|karte|tarjeta|carte",
    "phone": "phone|call|tel|mobile|fax|telefon|llama|appel",
    "iban": "iban|account|bank|konto|cuenta|compte",
    "ssn": "ssn|social|security|tax",
    "tel": "phone|call|tel|mobile|fax|telefon|llama|appel",
    "dni": "dni|nif|nie|identidad|documento",
    "nir": "nir|securite|sécurité|assur",
    "nhs": "nhs|patient|health|medical",
    "idnr": "steuer|idnr|identifikationsnummer|tin",
    "key": "key|token|secret|auth",
    "secret": "token|secret|passw|api|key|auth|bearer|credential|passwort|clave|jeton",
}
#: Words that speak against a span of an added kind.
AGAINST = {
    "ssn": "order|invoice|serial|version",
    "tel": "order|invoice|serial|version",
    "dni": "order|invoice|serial|pedido|factura",
    "nhs": "order|invoice|serial|isbn|phone|call|tel",
    "idnr": "order|invoice|serial|rechnung|bestell",
    "key": "example|placeholder",
    "secret": "sha|commit|checksum|digest|hash|md5|revision|etag|example|placeholder",
}
CONTEXT_CHARS, CONTEXT_SCORE = 40, 0.35
BLOCK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def located(text: Column, pattern: str) -> Column:
    """array<struct<m, s>> of the leftmost non-overlapping matches with their beginnings in code points.

    The texts between matches and the matches themselves alternate, so a beginning is a sum of lengths; sums are taken in blocks, so thousands of matches don't cost their square."""
    parts = F.struct(F.split(text, pattern, -1).alias("p"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))

    def placed(s: Column) -> Column:
        lengths = F.zip_with(F.slice(s["p"], 1, F.size(s["m"])), s["m"], lambda p, m: F.length(p) + F.length(m))

        def by_block(n: Column) -> Column:
            blocks = F.transform(F.sequence(F.lit(0), F.expr("0") + F.floor(F.size(n) / BLOCK).cast("int")), lambda b: F.aggregate(F.slice(n, b * BLOCK + 1, BLOCK), F.lit(0), lambda x, y: x + y))

            def begun(sums: Column) -> Column:
                def start(i: Column) -> Column:
                    b = F.floor(i / BLOCK).cast("int")
                    return (
                        F.aggregate(F.slice(sums, F.lit(1), b), F.lit(0), lambda x, y: x + y)
                        + F.aggregate(F.slice(n, b * BLOCK + 1, i - b * BLOCK), F.lit(0), lambda x, y: x + y)
                        + F.length(F.element_at(s["p"], i + 1))
                    )

                return F.transform(s["m"], lambda m, i: F.struct(m.alias("m"), start(i).alias("s")))

            return let(blocks, begun)

        return let(lengths, by_block)

    none = F.array().cast("array<struct<m:string,s:int>>")
    return let(parts, lambda s: F.when(F.size(s["m"]) == 0, none).otherwise(placed(s)))


def luhn(digits: Column) -> Column:
    """Whether the check digit of a string of digits is right: from the right, each second digit counts double, less 9 above 9."""
    def value(d: Column, i: Column) -> Column:
        return let(F.when(d != "", (F.ascii(d) - 48) * (1 + i % 2)), lambda v: F.when(v > 9, v - 9).otherwise(v))

    values = F.transform(F.split(F.reverse(digits), "(?<=.)"), value)
    return F.aggregate(F.filter(values, lambda v: v.isNotNull()), F.lit(0), lambda a, b: a + b) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN without spaces has remainder 1: first four characters moved to the end, letters as 10 to 35."""
    turned = F.concat(F.substring(iban, 5, 100), F.substring(iban, 1, 4))

    def add(r: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(c == "", r).when(code < 58, (r * 10 + code - 48) % 97).otherwise((r * 100 + code - 55) % 97)

    return F.aggregate(F.split(turned, "(?<=.)"), F.lit(0), add) == 1


#: The check letters of Spanish identity numbers, by the remainder of 23. Fixed value.
DNI_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"


def entropy(m: Column) -> Column:
    """Bits a character of a string by its own frequencies."""
    def of(letters: Column) -> Column:
        def term(a: Column, c: Column) -> Column:
            return let(F.length(m) - F.length(F.replace(m, c, F.lit(""))), lambda k: a - k / F.length(m) * F.log2(k / F.length(m)))

        return F.aggregate(letters, F.lit(0.0), term)

    return let(F.filter(F.array_distinct(F.split(m, "(?<=.)")), lambda c: c != ""), of)


def confirmed(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    n = F.length(digits)
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: p.cast("double") <= 255)
    if kind == "card":
        return n.between(13, 19) & luhn(digits)
    if kind == "phone":
        return n.between(9, 15)
    if kind == "dni":
        number = F.translate(F.substring(m, 1, 8), "XYZ", "012").cast("long")
        return F.right(m, F.lit(1)) == F.substring(F.lit(DNI_LETTERS), (number % 23 + 1).cast("int"), F.lit(1))
    if kind == "nir":
        return let(F.substring(digits, 1, 13).cast("long"), lambda v: 97 - v % 97 == F.substring(digits, 14, 2).cast("long"))
    if kind == "nhs":
        weighted = F.aggregate(F.sequence(F.lit(1), F.lit(9)), F.lit(0), lambda a, i: a + F.substring(digits, i, F.lit(1)).cast("int") * (11 - i))
        return (11 - weighted % 11) % 11 == F.substring(digits, 10, 1).cast("int")
    if kind == "idnr":
        def turn(p: Column, i: Column) -> Column:
            return let((F.substring(digits, i, F.lit(1)).cast("int") + p) % 10, lambda v: F.when(v == 0, 10).otherwise(v) * 2 % 11)

        check = F.aggregate(F.sequence(F.lit(1), F.lit(10)), F.lit(10), turn)
        return ((11 - check) % 10 == F.substring(digits, 11, 1).cast("int")) & (F.size(F.array_distinct(F.split(F.substring(digits, 1, 10), "(?<=.)"))) < 11)
    if kind == "key":
        return entropy(m) >= 3.0
    if kind == "secret":  # words joined by strokes have few digits
        return (n >= 3) & m.rlike("[A-Za-z]") & (entropy(m) >= 3.0)
    if kind == "ssn":
        return ~m.rlike("^(000|666|9)") & ~m.rlike("-00-") & ~m.rlike("-0000$")
    return n.between(9, 12) if kind == "tel" else F.lit(True)


def ibans(text: Column) -> Column:
    """array<struct<m, s>> of confirmed IBANs that don't overlap. What follows an IBAN may look like more of it, so it ends at its country's length; for a country without a known one, at the greatest length that confirms it. The next character is no letter or digit."""
    country = F.create_map(*[F.lit(x) for pair in IBAN_LENGTHS.items() for x in (pair[0], int(pair[1]))])

    def best(x: Column) -> Column:
        def longest(tail: Column) -> Column:
            def ends(reach: Column) -> Column:
                def tried(n: Column) -> Column:
                    bare = F.replace(F.substring(reach, F.lit(1), n), F.lit(" "), F.lit(""))
                    apart = ~F.substring(tail, n + 1, F.lit(1)).rlike("[A-Za-z0-9]") & (F.substring(reach, n, F.lit(1)) != " ")
                    fixed = F.try_element_at(country, F.substring(reach, 1, 2))
                    right = let(bare, lambda b: F.length(b).between(F.coalesce(fixed, F.lit(15)), F.coalesce(fixed, F.lit(34))) & mod97(b))
                    return F.when(F.when(apart, right).otherwise(False), n)

                n = F.array_max(F.transform(F.sequence(F.lit(15), F.greatest(F.length(reach), F.lit(15))), tried))
                return F.struct(F.substring(reach, F.lit(1), n).alias("m"), x["s"].alias("s"))

            return let(F.regexp_extract(tail, IBAN_CHARS, 0), ends)

        return let(F.substring(text, x["s"] + 1, F.lit(70)), longest)

    found = F.filter(F.transform(located(text, PATTERNS["iban"]), best), lambda x: x["m"].isNotNull())
    none = F.array().cast("array<struct<m:string,s:int>>")

    def add(kept: Column, x: Column) -> Column:
        free = let(F.try_element_at(kept, F.lit(-1)), lambda last: F.coalesce(last["s"] + F.length(last["m"]) <= x["s"], F.lit(True)))
        return F.when(free, F.concat(kept, F.array(x))).otherwise(kept)

    return F.aggregate(found, none, add)


def spans_of(text: Column, kind: str) -> Column:
    """Confirmed spans of a kind with their scores: array<struct<kind, start, end, score>>."""
    none = F.array().cast("array<struct<kind:string,start:int,end:int,score:double>>")
    found = ibans(text) if kind == "iban" else F.filter(located(text, PATTERNS[kind]), lambda x: F.when(confirmed(kind, x["m"]), True).otherwise(False))

    def scored(x: Column) -> Column:
        end = x["s"] + F.length(x["m"])
        near = F.concat(F.substring(text, F.greatest(x["s"] - CONTEXT_CHARS, F.lit(0)) + 1, F.least(x["s"], F.lit(CONTEXT_CHARS))), F.lit(" "), F.substring(text, end + 1, F.lit(CONTEXT_CHARS)))
        score = F.lit(SCORES[kind]) + F.when(near.rlike(rf"(?i)(?<![A-Za-z])(?:{CONTEXT[kind]})"), CONTEXT_SCORE).otherwise(0.0)
        if kind in AGAINST:
            score = score - F.when(near.rlike(rf"(?i)(?<![A-Za-z])(?:{AGAINST[kind]})"), CONTEXT_SCORE).otherwise(0.0)
        score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))
        return F.struct(F.lit(kind).alias("kind"), x["s"].alias("start"), end.alias("end"), score.alias("score"))

    spans = F.transform(found, scored)
    need = NEEDS.get(kind)
    possible = (F.instr(text, need) > 0) if need else text.rlike("[0-9]")
    return F.when(possible, spans).otherwise(none)


def find_personal_data(docs: DataFrame, *, threshold: float = 0.6, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, base and added: arrays of (kind, start, end, score), each kind in the order of PATTERNS, then by start; ends are exclusive, in code points.

    A row for each row of docs. A null or empty text has no spans; rows that repeat get equal results; null ids stay null. An added span that overlaps a base one is
    dropped, and so is one that overlaps an added span of a kind that stands before its own. Other columns are not read."""
    slim = docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("t"))
    slim = slim.select("doc_id", *[spans_of(F.col("t"), k).alias(k) for k in BASE_KINDS + ADDED_KINDS])
    base = slim.select("doc_id", F.concat(*BASE_KINDS).alias("base"), F.concat(*ADDED_KINDS).alias("proposed"))
    def over(x: Column, spans: Column) -> Column:
        return F.exists(spans, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))

    likely = F.filter("proposed", lambda x: (x["score"] >= threshold) & ~over(x, F.col("base")))
    kept = F.aggregate(likely, F.filter("proposed", lambda x: F.lit(False)), lambda a, x: F.when(over(x, F.filter(a, lambda b: b["kind"] != x["kind"])), a).otherwise(F.concat(a, F.array(x))))
    return base.select("doc_id", "base", F.when(F.size("proposed") == 0, F.col("proposed")).otherwise(kept).alias("added"))


def as_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_data_digest(docs: DataFrame, **options) -> DataFrame:
    """Counts of the base kinds, the SHA-256 of their spans, and all spans, of each document."""
    found = find_personal_data(docs, **options)

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(as_text(F.col("base")), 256).alias("base_sha256"), as_text(F.concat("base", "added")).alias("spans"))


def redacted(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """doc_id and text with each span replaced by its kind in angle brackets; of overlapping spans the one that begins first, then the longer one, counts."""
    slim = docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("t"))
    spans = slim.select("doc_id", "t", *[spans_of(F.col("t"), k).alias(k) for k in BASE_KINDS + ADDED_KINDS])
    threshold = options.get("threshold", 0.6)
    both = F.filter(F.concat(*BASE_KINDS, *ADDED_KINDS), lambda x: x["kind"].isin(*BASE_KINDS) | (x["score"] >= threshold))
    ordered = F.array_sort(F.transform(both, lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("neg_end"), x["kind"].alias("kind"))))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(s: Column, x: Column) -> Column:
        put = F.struct((-x["neg_end"]).alias("at"), F.concat(s["out"], F.substring("t", s["at"] + 1, x["start"] - s["at"]), F.lit("<"), x["kind"], F.lit(">")).alias("out"))
        return F.when(x["start"] >= s["at"], put).otherwise(s)

    done = F.aggregate(ordered, start, step, lambda s: F.concat(s["out"], F.substring("t", s["at"] + 1, F.length("t"))))
    return spans.select("doc_id", done.alias("text"))
