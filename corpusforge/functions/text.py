"""Text expressions: cleaning, tokens, intents and small parsers. All stay inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The patterns that cleaning, intent detection and grading recognise.
COLOR_MACRO = r"\$\\color\{[^}]*\}\{([^}]*)\}\$"
IMAGE_EMBED = r"!\[[^\]]*\]\([^)]*\)"
ENCODED_LINK = r"\[([^\]]*)\]\((?!https?://)(?=(?:[^()]|\([^()]*\))*%)(?:[^()]|\([^()]*\))*\)"
LEFTOVER_TARGET = r"\]\((?!https?://)(?:[^()]|\([^()]*\))*%[0-9A-Fa-f]{2}(?:[^()]|\([^()]*\))*\)"
HTML_TAG = r"(?i)</?(?:br|div|span|aside|img|p)\b[^>]*/?>"
REAL_URL = r"https?://\S+"
TOKEN = r"\p{L}+|\p{N}+"
NOT_GRAM = r"[^0-9A-Za-z가-힣]+"
HISTORY = (
    r"이전\s*(버전|판)|예전|과거|옛\s*(버전|판)|구\s*버전|당시"
    r"|\bv\d+\s*(에서|에는|의)|(\d{4})\s*년\s*(기준|당시|버전|판)"
    r"|바뀌기\s*전|수정\s*전|개정\s*전|업데이트\s*전"
)
COMPARISON = r"중\s*(더|먼저|나중|늦게|어느|어떤|무엇)"
AGGREGATION = r"몇\s*(편|건|배)|(총|합치면|모두)\s*몇"
ENUMERATION = r"들을?\s*(알려|무엇|모두)|모두\s*(알려|나열)|(?:몇|\d+|[한두세네]|다섯|여섯)\s*가지|들을?\s*어떤\s*순서"
REFUSAL = (
    r"찾을 수 없|알 수 없|정보가 없|정보는 없|포함되어 있지 않|포함되지 않"
    r"|언급이 없|언급되어 있지 않|언급되지 않|나와 있지 않|나타나 있지 않"
    r"|제공되지 않|확인할 수 없|명시되어 있지 않|기재되어 있지 않"
)
REWRITE_PREFIX = r"^\s*(재작성(된)?\s*질문|질문|검색\s*질의|답변)\s*[:：]\s*"
FULL_WIDTH, HALF_WIDTH = "。，、：；！？（）「」『』", ".,,:;!?()\"\"\"\""
FOREIGN = "[一-鿿]"
QUOTES = "\"'`“”‘’"
DEFECTS = {
    "color_macro": r"\$\\color\{",
    "image_embed": r"!\[[^\]]*\]\(",
    "html_tag": r"(?i)</?(?:br|div|span|aside|img|p)\b[^>]*>",
    "encoded_path": r"%[0-9A-Fa-f]{2}",
    "blank_lines": r"\n{3,}",
}
REVIEW = {"mermaid": r"(?m)```mermaid|^\s*(?:graph|sequenceDiagram|flowchart)\s"}


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), where value is worked out once a row although body uses it inside a lambda."""
    return F.transform(F.array(value), body)[0]


def trim_all(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def collapse_blank_lines(text: Column) -> Column:
    return F.regexp_replace(text, r"\n{3,}", "\n\n")


def normalize_ws(text: Column) -> Column:
    """No blanks at line ends, two newlines at most in a row, nothing around."""
    return trim_all(collapse_blank_lines(F.regexp_replace(text, r"(?m)[ \t]+$", "")))


def strip_html(text: Column) -> Column:
    return F.regexp_replace(text, HTML_TAG, " ")


def clean_markdown(text: Column) -> Column:
    """Macros unwrapped, images dropped, links with encoded inner paths reduced to their text, tags to blanks, blank lines collapsed; in this order."""
    text = F.regexp_replace(text, COLOR_MACRO, "$1")
    text = F.regexp_replace(text, IMAGE_EMBED, "")
    text = F.regexp_replace(text, ENCODED_LINK, "$1")
    text = F.regexp_replace(text, LEFTOVER_TARGET, "")
    return collapse_blank_lines(strip_html(text))


def drop_thousands_commas(text: Column) -> Column:
    # The comma comes first in the pattern: a look-behind there would be tried at every character.
    return F.regexp_replace(text, r",(?<=\d,)(?=\d{3}(?:\D|$))", "")


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters or digits, thousands commas dropped."""
    return F.regexp_extract_all(F.lower(drop_thousands_commas(text)), F.lit(TOKEN), F.lit(0))


def sentences(text: Column) -> Column:
    """Split after a full stop and blanks, after a closing syllable and a line end, or at an empty line."""
    parts = F.split(text, r"(?<=[.!?])\s+|(?<=[다요임음함])\s*\n+|\n{2,}")
    return F.filter(F.transform(parts, trim_all), lambda s: s != "")


def char_grams(text: Column, n: int = 5) -> Column:
    """Distinct character n-grams of the text without marks and blanks; a shorter text is its own gram."""

    # A look-ahead matches at each character in turn: one pass of the pattern, no walk to a place from the start.
    every = lambda bare: F.when(F.length(bare) < n, F.array(bare)).otherwise(F.regexp_extract_all(bare, F.lit(f"(?=(.{{{n}}}))"), F.lit(1)))
    return F.array_distinct(once(F.regexp_replace(text, NOT_GRAM, ""), every))


def wants_history(question: Column) -> Column:
    return question.rlike(HISTORY)


def question_type(question: Column) -> Column:
    return F.when(question.rlike(COMPARISON), "comparison").when(question.rlike(AGGREGATION), "aggregation").when(question.rlike(ENUMERATION), "enumeration").otherwise("fact")


def normalize_punctuation(text: Column) -> Column:
    return F.translate(text, FULL_WIDTH, HALF_WIDTH)


def folded(text: Column) -> Column:
    """A form in which texts that differ in case alone are equal. Lower case isn't one: the capitals of ß are SS."""
    return F.upper(F.lower(text))


def refuses(answer: Column) -> Column:
    return answer.rlike(REFUSAL)


def _lines(raw: Column) -> Column:
    trimmed = F.transform(F.split(raw, "\n"), trim_all)
    return F.filter(trimmed, lambda x: (x != "") & ~x.rlike("[:：]\\s*$"))


def _bare(line: Column) -> Column:
    return F.regexp_replace(trim_all(line), f"^[{QUOTES}]+|[{QUOTES}]+$", "")


def clean_rewrite(raw: Column, original: Column, most: int = 200) -> Column:
    """The first line that isn't an announcement, without label and quotes; null if too short or the original."""
    line = _bare(F.regexp_replace(F.get(_lines(raw), F.lit(0)), REWRITE_PREFIX, ""))
    return F.when((F.length(line) >= 2) & (line != trim_all(original)), F.substring(line, 1, most))


def clean_hypothetical(raw: Column, most: int = 500) -> Column:
    """All lines that aren't announcements, joined; null if too short."""
    text = _bare(F.array_join(F.transform(_lines(raw), lambda x: F.regexp_replace(x, REWRITE_PREFIX, "")), " "))
    return F.when(F.length(text) >= 2, F.substring(text, 1, most))


def expansion_terms(query: Column, hypothetical: Column) -> Column:
    """Distinct ASCII tokens of the hypothetical text that the query lacks, in order; null if there are none."""
    new = F.filter(F.array_except(tokens(hypothetical), tokens(query)), lambda t: t.rlike("^[a-z0-9]+$"))
    return F.when(F.size(new) > 0, F.array_join(new, " "))


def own_script(answer: Column, foreign: str = FOREIGN, run: int = 3, least: int = 20) -> Column:
    """The sentences with fewer than `run` characters of a foreign script; null if fewer than `least` characters are left."""
    count = lambda s: F.length(s) - F.length(F.regexp_replace(s, foreign, ""))
    kept = F.filter(F.split(answer, r"(?<=[.!?。])\s+|\n+"), lambda s: (trim_all(s) != "") & (count(s) < run))
    out = trim_all(F.array_join(kept, " "))
    return F.when(F.length(out) >= least, out)


def keep_script(answer: Column, foreign: str = FOREIGN, run: int = 3, least: int = 20) -> Column:
    """Drop sentences with `run` or more characters of a foreign script, if at least `least` characters are left."""
    return F.when(~answer.rlike(foreign), answer).otherwise(F.coalesce(own_script(answer, foreign, run, least), answer))


def parse_plan(text: Column, fallback: Column, most: int = 3) -> Column:
    """Strings of the first JSON array in the text, trimmed, `most` at most; else the fallback alone."""
    items = F.from_json(F.regexp_extract(text, r"(?s)\[.*?\]", 0), "array<string>")
    items = F.slice(F.filter(F.transform(items, trim_all), lambda s: s.isNotNull() & (s != "")), 1, most)
    return F.when(F.coalesce(F.size(items), F.lit(0)) > 0, items).otherwise(F.array(fallback))


def normalize_entity(name: Column) -> Column:
    """Blanks collapsed; lower case if the name is all ASCII."""
    name = trim_all(F.regexp_replace(name, r"\s+", " "))
    return F.when(name.rlike(r"^\p{ASCII}*$"), F.lower(name)).otherwise(name)


def has_final_consonant(word: Column) -> Column:
    """Whether the last character is a Hangul syllable that ends in a consonant."""
    point = F.ascii(F.right(trim_all(word), F.lit(1)))
    return F.coalesce((point >= 0xAC00) & (point <= 0xD7A3) & ((point - 0xAC00) % 28 != 0), F.lit(False))


def render_question(template: Column, subject: Column) -> Column:
    """Fill a template; {eun_neun}, {i_ga} and {eul_reul} become the particle that fits the subject's last sound."""
    final = has_final_consonant(subject)
    for name, closed, open_ in (("{eun_neun}", "은", "는"), ("{i_ga}", "이", "가"), ("{eul_reul}", "을", "를")):
        template = F.replace(template, F.lit(name), F.when(final, closed).otherwise(open_))
    return F.replace(template, F.lit("{s}"), subject)


def version_of(path: Column) -> Column:
    """archive/<version>/... with three parts or more: that version, superseded; else current."""
    parts = F.split(path, "/")
    old = (F.size(parts) >= 3) & (F.get(parts, F.lit(0)) == "archive")
    version = F.when(old, F.get(parts, F.lit(1))).otherwise("current")
    name = F.when(old, F.concat_ws("@", F.element_at(parts, -1), F.get(parts, F.lit(1)))).otherwise(path)
    return F.struct(version.alias("version"), old.alias("superseded"), name.alias("source"))
