"""Column functions over page text and values. Patterns run with Unicode classes and case folding."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafmine import rules as R

#: Before every pattern: ignore case, Unicode classes, only LF ends a line.
I = "(?iuUd)"  # noqa: E741
S = "(?iuUds)"


def strip(c: Column, chars: str = r"\s") -> Column:
    """c without the given characters (of a regex class) at both ends."""
    return F.regexp_replace(c, rf"(?U)^[{chars}]+|[{chars}]+$", "")


def clean_text(c: Column) -> Column:
    """PG1: no-break spaces become spaces, CR becomes LF, runs of blanks one space, three or more LF two; trimmed."""
    c = F.translate(c, "\u00a0\r", " \n")
    return strip(F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def file_priority(name: Column, hints: list = R.PRIORITIES) -> Column:
    """PG5: the largest weight of the hints that a file name contains; 50 if none."""
    low = F.lower(name)
    return F.coalesce(F.greatest(*[F.when(low.contains(k), F.lit(w)) for k, w in hints]), F.lit(50))


def page_ref(file: Column, page: Column, ocr: Column) -> Column:
    """PG9: "f.pdf (p.3, OCR)", or "f.docx (whole file)" for page 0."""
    inside = F.when(page > 0, F.concat(F.lit("p."), page.cast("string"))).otherwise(F.lit("whole file"))
    return F.concat(file, F.lit(" ("), inside, F.when(ocr, F.lit(", OCR")).otherwise(F.lit("")), F.lit(")"))


def is_junk_line(c: Column) -> Column:
    """PG10: empty, with a Devanagari character, or of 15 or more characters of which under 35 % are alphanumeric."""
    solid = F.length(F.regexp_replace(c, r"[^\p{L}\p{N}]", ""))
    return (F.coalesce(F.length(c), F.lit(0)) == 0) | c.rlike(r"[\x{0900}-\x{097F}]") | ((F.length(c) >= 15) & (solid / F.length(c) < 0.35))


def first_date(c: Column) -> Column:
    """VP3: the first date as written, empty if none."""
    return strip(F.regexp_extract(c, I + R.DATE, 0))


def percent_of(c: Column) -> Column:
    """VP4: "5.0% of the total Contract Price", empty if none."""
    share, basis = F.regexp_extract(c, I + R.PERCENT_OF, 1), F.regexp_extract(c, I + R.PERCENT_OF, 2)
    return F.when(share == "", F.lit("")).otherwise(F.concat(share, F.lit("% of "), strip(F.regexp_replace(basis, r"(?U)\s+", " "))))


def is_nil(c: Column) -> Column:
    """VP5: an explicit "not applicable", "nil" and the like is an answer."""
    return c.rlike(I + R.NIL)


def nil_text(c: Column) -> Column:
    """VP5: the phrase, each letter after a non-letter in upper case."""
    found = F.lower(strip(F.regexp_extract(c, I + R.NIL, 0)))
    letters = F.split(found, "")
    after = F.zip_with(letters, F.concat(F.array(F.lit(" ")), F.slice(letters, 1, F.greatest(F.size(letters) - 1, F.lit(0)))), lambda x, y: F.when(y.rlike(r"\p{L}"), x).otherwise(F.upper(x)))
    return F.array_join(after, "")


def has_threshold(c: Column) -> Column:
    """VP6."""
    return c.rlike(I + R.THRESHOLD)


def money_number(c: Column) -> Column:
    """VP7: the first number, scaled by crore or lakh directly after it; null if none."""
    digits = F.regexp_extract(c, r"(?U)(\d[\d,]*(?:\.\d+)?)", 1)
    tail = F.regexp_extract(c, r"(?Us)\d[\d,]*(?:\.\d+)?(.{0,14})", 1)
    value = F.regexp_replace(digits, ",", "").try_cast("double")
    times = F.when(tail.rlike(I + r"^\s*(?:/-)?\s*(?:crores?|cr\b)"), F.lit(1e7)).when(tail.rlike(I + r"^\s*(?:/-)?\s*(?:lakh?s?|lacs?)"), F.lit(1e5)).otherwise(F.lit(1.0))
    return F.when(digits != "", value * times)


def is_weak_value(field: Column, value: Column) -> Column:
    """VP9: a value that parsed but says nothing."""
    v = strip(value)
    generic = F.when(field == "purpose", v.rlike(I + R.GENERIC["purpose"])).when(field == "location", v.rlike(I + R.GENERIC["location"])).otherwise(F.lit(False))
    form = field.isin("purpose", "location") & v.rlike(I + R.FORM_LABEL)
    short = (field == "purpose") & (F.regexp_count(v, F.lit("[A-Za-z]{2,}")) < 3)
    bare = (field == "location") & (F.length(v) < 60) & ~v.rlike(I + R.ADDRESS)
    return generic | form | short | bare


def dedupe_repeat(c: Column) -> Column:
    """VP11: "X X" becomes "X" if each half is longer than 8."""
    half = F.floor(F.length(c) / 2).cast("int")
    left, right = strip(F.substring(c, F.lit(1), half)), strip(F.substring(c, half + 1, F.length(c)))
    return F.when((half > 8) & (left == right), left).otherwise(c)


def _word_list(names) -> str:
    return "|".join(sorted(names, key=lambda s: (-len(s), s)))


def split_city_state(address: Column, gazetteer: dict[str, str] | None = None) -> Column:
    """VP12: struct(city, state) of an address; empty strings if not found. The gazetteer becomes one pattern and one map in the plan;
    see operators.places for one of any size."""
    gazetteer = gazetteer or R.default_gazetteer()
    text = strip(F.coalesce(address, F.lit("")))
    found = F.regexp_extract(text, rf"{I}\b({_word_list(gazetteer)})\b", 1)
    known = F.create_map(*[F.lit(x) for kv in gazetteer.items() for x in kv])
    return city_and_state(text, found, known[F.upper(found)])


def city_and_state(text: Column, found: Column, of: Column) -> Column:
    """VP12 once the first city of a text is found (empty: none) and its state (of, may be null): the state that the text names, else that of
    the city; a city in capitals in lower case; without one, what stands before the state."""
    state = F.regexp_extract(text, rf"{I}\b({_word_list(R.STATES)})\b", 1)
    named = F.when(found == F.upper(found), F.concat(F.upper(F.substring(found, 1, 1)), F.lower(F.substring(found, F.lit(2), F.length(found))))).otherwise(found)
    before = F.regexp_replace(F.regexp_extract(text, rf"(?iuUds)^(.*?)\b(?:{_word_list(R.STATES)})\b", 1), "[ ,-]+$", "")
    pieces = F.reverse(F.split(before, r"[,\-]"))
    words = F.transform(pieces, lambda p: F.filter(F.split(strip(p), r"(?U)\s+"), lambda w: (w != "") & ~w.rlike(I + R.PLACE_NOISE)))
    full = F.filter(words, lambda w: F.size(w) > 0)
    last = F.when(F.size(full) > 0, F.element_at(full, 1)).otherwise(F.array().cast("array<string>"))
    near = F.initcap(F.array_join(F.slice(last, F.greatest(F.size(last) - 1, F.lit(1)), F.lit(2)), " "))
    city = F.when(found != "", named).when(state != "", near).otherwise(F.lit(""))
    return F.struct(city.alias("city"), F.when(state != "", state).when(found != "", F.coalesce(of, F.lit(""))).otherwise(F.lit("")).alias("state"))


def value_after_label(c: Column, label: str, window: int = 150) -> Column:
    """VP13: after the first hit of a label, the first date within the window, else a nil phrase, else empty."""
    tail = F.regexp_extract(c, rf"{S}(?:{label})(.{{0,{window}}})", 1)
    return F.when(first_date(tail) != "", first_date(tail)).otherwise(nil_text(tail))


def strip_echoed_heading(value: Column, field: Column, headings: dict = R.HEADINGS) -> Column:
    """VP14: a short first line that only repeats the field's heading goes."""
    first = strip(F.substring_index(value, "\n", 1))
    rest = F.regexp_replace(F.substring(value, F.length(F.substring_index(value, "\n", 1)) + 2, F.length(value)), "^\n+", "")
    echo = F.lit(False)
    for name, patterns in headings.items():
        echo = echo | ((field == name) & first.rlike(rf"{I}^(?:{'|'.join(patterns)}).{{0,25}}$"))
    return F.when((F.length(first) <= 70) & echo, rest).otherwise(value)


def is_junk_money_answer(c: Column) -> Column:
    """VP15: neither a figure nor a nil phrase."""
    v = strip(F.coalesce(c, F.lit("")))
    return (v == "") | (~is_nil(v) & ~v.rlike(r"(?U)\d"))


def due_date(c: Column) -> Column:
    """VP16: the first d-m-y (two-digit years from 2000; overflowing days and months roll over), else d Mon yyyy.

    Unanchored as in the source of these rules: 2026-08-25 reads as 26-08-25.
    """
    num = [F.regexp_extract(c, r"(\d{1,2})[-/.](\d{1,2})[-/.](\d{2,4})", i).try_cast("int") for i in (1, 2, 3)]
    word = [F.regexp_extract(c, rf"(?i)(\d{{1,2}})\s+({R.MONTHS})[a-z]*\s+(\d{{4}})", i) for i in (1, 2, 3)]
    month = _month(word[1]).cast("int")
    year = F.when(num[2] < 100, num[2] + 2000).otherwise(num[2])
    rolled = lambda y, m, d: F.date_add(F.add_months(F.make_date(y, F.lit(1), F.lit(1)), m - 1), d - 1)
    return F.when(num[0].isNotNull() & num[1].isNotNull() & num[2].isNotNull(), rolled(year, num[1], num[0])).when(word[0] != "", rolled(word[2].try_cast("int"), month, word[0].try_cast("int")))


def _month(name: Column) -> Column:
    return F.array_position(F.array(*[F.lit(m.lower()) for m in R.MONTHS.split("|")]), F.lower(name.substr(1, 3)))


def format_inr(v: Column) -> Column:
    """VP17: crore and lakh with two decimals, smaller amounts grouped."""
    return F.when(v >= 1e7, F.format_string("Rs %.2f cr", v / 1e7)).when(v >= 1e5, F.format_string("Rs %.2f lakh", v / 1e5)).otherwise(F.concat(F.lit("Rs "), F.format_number(v, 0)))


ANSWER = "struct<fields: map<string, struct<value: string, source_file: string, page: string, confidence: string>>>"


def bare_answer(c: Column) -> Column:
    """An answer without its code fences."""
    return strip(F.regexp_replace(c, r"(?m)^```(?:json)?|```$", ""))


def answer_fields(bare: Column) -> Column:
    """The fields of a bare answer; if it doesn't parse, of what stands from the first { to the last }. Each is parsed once at most."""
    inner = F.regexp_extract(bare, r"(?s)(\{.*\})", 1)
    return F.coalesce(F.when(bare.startswith("{"), F.from_json(bare, ANSWER)["fields"]), F.from_json(inner, ANSWER)["fields"])


def parse_answer_json(c: Column) -> Column:
    """VP18: an answer without its code fences; if it doesn't parse, what stands from the first { to the last }."""
    return F.struct(answer_fields(bare_answer(c)).alias("fields"))
