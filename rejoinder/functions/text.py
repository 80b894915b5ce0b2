"""Column expressions on texts, identifiers and categories. All run in the JVM; null handling is part of each."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the domain.
MIN_TEXT = 20
PLACEHOLDERS = ("[deleted]", "[removed]", "")
BOT_WORDS = ("bot", "automoderator", "spam", "moderationbot")
WARNING_WORDS = ("warn", "vandal", "block", "spam", "uw-")
RESTRICTION_WORDS = ("revert", " rv ", "undid", "undo")
POSITIVE_WORDS = ("welcome", "thanks")
INTERVENTION_WORDS = ("warn", "vandal", "block", "spam", "uw-", "revert", " rv ", "undid", "undo", "welcome", "thanks", "civil")
INTERVENTION_TEMPLATES = ("{{uw-", "{{welcome", "{{warning", "{{bansummary", "{{indef-block", "{{blocked", "wp:civil")
NAMESPACES = {1: "Talk", 3: "User talk", 5: "Wikipedia talk"}
TALK_PREFIX = "User talk:"
#: White space of any script, each character by itself.
BLANKS = " " + "".join(chr(c) for c in (*range(0x09, 0x0E), *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
#: Space separators alone (Unicode's Zs), which are what SQL's trim takes: no tabs and line ends.
SPACES = " " + "".join(chr(c) for c in (0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000))


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x: Column | str, blanks: str = BLANKS) -> Column:
    """Without leading and trailing white space of any script, or without other characters."""
    return F.btrim(col(x), F.lit(blanks))


def clean(x: Column | str) -> Column:
    """White space collapsed to single spaces and trimmed; null gives ''."""
    blank = F.translate(F.coalesce(col(x), F.lit("")), BLANKS, " " * len(BLANKS))  # half the time of a pattern of them all
    return F.trim(F.regexp_replace(blank, "  +", " "))


def words(x: Column | str) -> Column:
    """The words of a text. Where several features need them, give them a column and use the functions that end in _of."""
    return words_of(clean(x))


def words_of(cleaned: Column | str) -> Column:
    return F.array_remove(F.split(col(cleaned), " "), "")


def count_of(own: Column | str, blank: int | None = None) -> Column:
    n = F.size(col(own))
    return F.when(n > 0, n).otherwise(F.lit(blank).cast("int"))


def word_count(x: Column | str, blank: int | None = None) -> Column:
    """Words; a blank or null text gives ``blank``."""
    return count_of(words(x), blank)


def char_count(x: Column | str) -> Column:
    """Length as it is; null for a blank or null text."""
    return F.when(F.length(strip(x)) > 0, F.length(col(x)))


def shouted(own: Column | str) -> Column:
    """The upper-case words of two characters or more. A column of it serves both functions below."""
    return F.filter(col(own), lambda w: (F.length(w) >= 2) & (w == F.upper(w)) & (w != F.lower(w)))


def caps_abuse_of(own: Column | str, share: float = 0.30, loud: Column | str | None = None) -> Column:
    long_, n = F.size(F.filter(col(own), lambda w: F.length(w) >= 2)), F.size(shouted(own) if loud is None else col(loud))
    return F.when(long_ > 0, n / long_ > share).otherwise(F.lit(False))


def caps_abuse(x: Column | str, share: float = 0.30) -> Column:
    """Over ``share`` of the words of two characters or more are upper case."""
    return caps_abuse_of(words(x), share)


def caps_share_of(own: Column | str, loud: Column | str | None = None) -> Column:
    n = F.size(col(own))
    return F.when(n > 0, F.size(shouted(own) if loud is None else col(loud)) / n).otherwise(F.lit(0.0))


def caps_share(x: Column | str) -> Column:
    """Upper-case words of two characters or more over all words; 0 without words."""
    return caps_share_of(words(x))


def has_question(x: Column | str) -> Column:
    return F.coalesce(F.contains(col(x), F.lit("?")), F.lit(False))


def is_placeholder(x: Column | str, null_is: bool = True) -> Column:
    return F.coalesce(F.lower(strip(x)).isin(*PLACEHOLDERS), F.lit(null_is))


def is_bot(x: Column | str) -> Column:
    return F.lower(F.coalesce(col(x), F.lit(""))).rlike("|".join(BOT_WORDS))


def is_valid(*texts: Column | str, least: int = MIN_TEXT) -> Column:
    return reduce(lambda a, b: a & b, [F.coalesce(F.length(col(t)) >= least, F.lit(False)) for t in texts])


def has_any(x: Column | str, needles) -> Column:
    quoted = "|".join("\\Q" + n + "\\E" for n in needles)
    return F.coalesce(F.lower(col(x)).rlike(quoted), F.lit(False))


def is_intervention(comment: Column | str, text: Column | str) -> Column:
    return has_any(comment, INTERVENTION_WORDS) | has_any(text, INTERVENTION_TEMPLATES)


def html_text(x: Column | str) -> Column:
    """Text of an HTML fragment without scripts, styles and comments; tags part words. Named entities: the common ones."""
    t = F.coalesce(col(x), F.lit(""))
    t = F.regexp_replace(t, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    t = F.regexp_replace(t, r"(?s)<[^>]*>", " ")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(char))
    return clean(t)


def tag_list(x: Column | str) -> Column:
    """'<a><b>' gives 'a b'."""
    return F.regexp_replace(F.replace(F.coalesce(col(x), F.lit("")), F.lit("><"), F.lit(" ")), "^[<>]+|[<>]+$", "")


def added_content(before: Column | str, after: Column | str, blanks: str = BLANKS) -> Column:
    """What an edit appended, whole: the tail beyond the old length if over MIN_TEXT characters longer, else the new text.

    blanks: characters that a tail neither begins nor ends with.
    """
    old, new = F.coalesce(col(before), F.lit("")), F.coalesce(col(after), F.lit(""))
    tail = strip(F.substring(new, F.length(old) + 1, F.length(new)), blanks)
    grown = (F.length(old) > 0) & (F.length(new) > F.length(old) + MIN_TEXT)
    return F.when(grown, tail).otherwise(new)


def article_edit(comment: Column | str, text: Column | str, cap: int = 1500) -> Column:
    """An edit's summary and excerpt as one text."""
    summary, excerpt = clean(comment), F.substring(clean(text), 1, cap)
    head = F.concat(F.lit("Edit summary: "), summary)
    both = F.concat(head, F.lit("\n\nArticle excerpt:\n"), excerpt)
    return F.when((summary != "") & (excerpt != ""), both).when(summary != "", head).otherwise(excerpt)


def wiki_type(comment: Column | str) -> Column:
    return (
        F.when(has_any(comment, WARNING_WORDS), "warning")
        .when(has_any(comment, RESTRICTION_WORDS), "restriction")
        .when(has_any(comment, POSITIVE_WORDS), "positive_reinforcement")
        .otherwise("reframe")
    )


def reddit_type(stickied: Column | str, flair: Column | str) -> Column:
    delta = F.coalesce(col(flair), F.lit("")).rlike("[∆Δ]")
    return F.when(F.coalesce(col(stickied), F.lit(False)), "warning").when(delta, "positive_reinforcement").otherwise("reframe")


def role(platform: Column | str, kind: Column | str) -> Column:
    p, k = col(platform), col(kind)
    return (
        F.when(p == "reddit", "peer")
        .when(p == "stackexchange", "domain_expert")
        .when((p == "wikipedia") & k.isin("warning", "restriction"), "formal_authority")
        .when(p == "wikipedia", "peer_editor")
        .otherwise("unknown")
    )


def strict_role(platform: Column | str, kind: Column | str) -> Column:
    """As role, but 'unknown' for a pair of platform and type that isn't listed."""
    p, k = col(platform), col(kind)
    listed = ((p == "reddit") & k.isin("positive_reinforcement", "reframe", "warning")) | ((p == "stackexchange") & (k == "reframe")) | ((p == "wikipedia") & k.isin("warning", "restriction", "reframe", "positive_reinforcement"))
    return F.when(listed, role(p, k)).otherwise("unknown")


def severity(kind: Column | str) -> Column:
    return F.when(col(kind).isin("warning", "restriction"), 3).when(col(kind) == "positive_reinforcement", 1).otherwise(2)


def visibility(platform: Column | str) -> Column:
    return F.when(col(platform) == "wikipedia", "semi_public").otherwise("public")


def timing(minutes: Column | str) -> Column:
    m = col(minutes)
    return F.when(m.isNull() | F.isnan(m.cast("double")), "unknown").when(m <= 60, "immediate").when(m <= 1440, "same_day").otherwise("delayed")


def tenure(days: Column | str) -> Column:
    d = col(days)
    return F.when(d.isNull() | (d <= -1), None).when(d <= 30, "newcomer").when(d <= 365, "regular").otherwise("veteran")


def first_truthy(*xs: Column | str) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(col(x), F.lit("")) for x in xs])


def talk_target(title: Column | str) -> Column:
    t = col(title)
    return F.when(F.startswith(t, F.lit(TALK_PREFIX)), F.substring(t, len(TALK_PREFIX) + 1, F.length(t)))


def namespace_name(ns: Column | str) -> Column:
    n = col(ns)
    return reduce(lambda e, kv: e.when(n == kv[0], kv[1]), NAMESPACES.items(), F.when(F.lit(False), "")).otherwise(n.cast("string"))


def round_half(x: Column | str) -> Column:
    """To the nearest half, ties to even."""
    return F.bround(col(x) * 2) / 2


def minutes_between(start: Column | str, end: Column | str) -> Column:
    return (F.unix_micros(col(end).cast("timestamp")) - F.unix_micros(col(start).cast("timestamp"))) / F.lit(6e7)


def confidence_level(x: Column | str) -> Column:
    """low, medium or high; anything else is low."""
    c = F.lower(F.trim(col(x)))
    return F.when(c.isin("low", "medium", "high"), c).otherwise("low")


def confidence_rank(x: Column | str) -> Column:
    return F.when(col(x) == "high", 3).when(col(x) == "medium", 2).when(col(x) == "low", 1)


def percent(n: Column | str, total: Column | str, none: str = "—") -> Column:
    return F.when(col(total) > 0, F.format_string("%.1f%%", F.bround(100.0 * col(n) / col(total), 1))).otherwise(none)  # halves to even


def _banded(x: Column | str, none: str, *bands: tuple[float | None, str]) -> Column:
    """The label of the first band whose upper end is above x."""
    v = col(x)
    e = F.when(v.isNull() | F.isnan(v), none)
    for top, label in bands:
        e = e.when(v < top, label) if top is not None else e.otherwise(label)
    return e


def stars(p: Column | str) -> Column:
    return _banded(p, "ns", (0.001, "***"), (0.01, "**"), (0.05, "*"), (None, "ns"))


def effect_label(eta: Column | str) -> Column:
    return _banded(eta, "unknown", (0.01, "negligible"), (0.06, "small"), (0.14, "medium"), (None, "large"))


def icc_label(icc: Column | str) -> Column:
    return _banded(icc, "(insufficient data)", (0.50, "poor"), (0.75, "moderate"), (0.90, "good"), (None, "excellent"))


def kappa_label(kappa: Column | str) -> Column:
    return _banded(kappa, "(insufficient data)", (0.20, "slight"), (0.40, "fair"), (0.60, "moderate"), (0.80, "substantial"), (None, "near-perfect"))


def bar(share: Column | str, width: int = 20) -> Column:
    n = F.bround(col(share) * width).cast("int")
    return F.concat(F.repeat(F.lit("█"), n), F.repeat(F.lit("░"), F.lit(width) - n))


def platform_of(record_id: Column | str) -> Column:
    return F.split(col(record_id), "_")[0]


def blinded_to_platform(record_id: Column | str) -> Column:
    """bl_, mn_ and di_ ids to those of their platforms."""
    r = col(record_id)
    for short, name in (("bl", "reddit"), ("mn", "stackexchange"), ("di", "wikipedia")):
        r = F.regexp_replace(r, f"^{short}_", f"{name}_")
    return r


def row_mean(*xs: Column | str) -> Column:
    """Mean of those that aren't null."""
    n = reduce(lambda a, b: a + b, [col(x).isNotNull().cast("int") for x in xs])
    return F.when(n > 0, reduce(lambda a, b: a + b, [F.coalesce(col(x), F.lit(0.0)) for x in xs]) / n)


def row_std(*xs: Column | str, ddof: int = 1) -> Column:
    """Standard deviation of those that aren't null."""
    have = F.filter(F.array(*[col(x).cast("double") for x in xs]), lambda v: v.isNotNull())
    mean = F.aggregate(have, F.lit(0.0), lambda a, v: a + v) / F.size(have)
    squares = F.aggregate(F.transform(have, lambda v: (v - mean) * (v - mean)), F.lit(0.0), lambda a, v: a + v)
    return F.when(F.size(have) > ddof, F.sqrt(squares / (F.size(have) - ddof)))


def formatted_xml_row(line: Column | str) -> Column:
    """An XML row's attributes one a line, values of 100 characters or more cut to 97 and '...'."""
    x = col(line)
    tag = F.regexp_extract(x, r"(?s)^\s*<(\w+)\s+.*?\s*/>", 1)
    names, values = (F.regexp_extract_all(x, F.lit(r'(\w+)="([^"]*)"'), F.lit(i)) for i in (1, 2))
    shown = F.transform(values, lambda v: F.when(F.length(v) < 100, v).otherwise(F.concat(F.substring(v, 1, 97), F.lit("..."))))
    rows = F.transform(F.arrays_zip(names.alias("n"), shown.alias("v")), lambda s: F.concat(F.lit("  "), s["n"], F.lit('="'), s["v"], F.lit('"\n')))
    return F.when(tag == "", x).otherwise(F.concat(F.lit("<"), tag, F.lit("\n"), F.array_join(rows, ""), F.lit("/>")))
