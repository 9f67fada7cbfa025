"""Text: search terms, normal forms, bounds, ids, markup."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Term:
    """One word, phrase or prefix of a search text, as its tokens."""

    kind: str
    words: tuple[str, ...]


def split_tokens(text: str) -> tuple[str, ...]:
    return tuple(w for w in re.split(r"[\W_]+", text.lower()) if w)


def parse_query(text: str) -> list[Term]:
    """White space separates terms, which must all match; "..." is a phrase, a trailing * a prefix; all else is literal."""
    out = []
    for quoted, open_quote, word in re.findall(r'"([^"]*)"|"(.*)$|([^\s"]+)', text):
        words = split_tokens(quoted or open_quote or word)
        if not words:
            continue
        if word.endswith("*") and not quoted and not open_quote:
            out.append(Term("prefix", words))
        else:
            out.append(Term("word" if len(words) == 1 else "phrase", words))
    return out


def token_line(text: Column | str) -> Column:
    """Lower-case runs of letters and digits with one space between them."""
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " ")


def tokens(text: Column | str) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(token_line(text), " "), lambda x: x != "")


def pattern_of(term: Term) -> str:
    """A pattern that lower-case text contains where its tokens hold the term: the words between other characters, the last of a prefix open at its end."""
    ends = "" if term.kind == "prefix" else r"(?![\p{L}\p{N}])"
    return r"(?<![\p{L}\p{N}])" + r"[^\p{L}\p{N}]+".join(term.words) + ends


def _any_starts(words: Column, prefix: str) -> Column:
    return F.exists(words, lambda x: x.startswith(prefix))


def matches(words: Column, terms: list[Term]) -> Column:
    """Whether a token array matches all terms. No terms match nothing."""
    if not terms:
        return F.lit(False)
    line = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    found = []
    for term in terms:
        if term.kind == "word":
            found.append(F.array_contains(words, term.words[0]))
        elif term.kind == "prefix" and len(term.words) == 1:
            found.append(_any_starts(words, term.words[0]))
        else:
            found.append(line.contains(f" {' '.join(term.words)}{'' if term.kind == 'prefix' else ' '}"))
    return reduce(lambda a, b: a & b, found)


def may_match(text: Column | str, terms: list[Term]) -> Column:
    """Whether the letters of every word occur at all, longest word first: cheaper than patterns, true wherever they are, so it goes before them."""
    low = F.lower(F.col(text) if isinstance(text, str) else text)
    words = sorted({w for term in terms for w in term.words}, key=lambda w: (-len(w), w))
    return reduce(lambda a, b: a & b, [low.contains(w) for w in words], F.lit(True))


def found(text: Column | str, terms: list[Term]) -> Column:
    """Whether a text matches all terms, as `matches` does on its tokens, but on the text itself. No terms match nothing."""
    if not terms:
        return F.lit(False)
    low = F.lower(F.col(text) if isinstance(text, str) else text)
    return F.coalesce(reduce(lambda a, b: a & b, [low.rlike(pattern_of(t)) for t in terms], may_match(text, terms)), F.lit(False))


def normal_subject(subject: Column) -> Column:
    """Without repeated reply and forward marks."""
    return F.regexp_replace(subject, r"(?i)^\s*((re|fw|fwd|aw|wg|sv)[ \t]*:\s*)*|\s+$", "")


def normal_message_id(value: Column) -> Column:
    """Without outer angle brackets, in lower case."""
    return F.lower(F.regexp_replace(F.trim(value), r"^<(.*)>$", "$1"))


def bounded(text: Column, most: int) -> Column:
    """At most `most` characters, the last of a cut text an ellipsis."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 1), F.lit("…"))).otherwise(text)


def one_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def content_hash(*parts: Column) -> Column:
    """SHA-256 of the parts joined by NUL; a null part counts as empty but for a mark of its own."""
    return F.sha2(F.concat_ws("\0", *(F.coalesce(p.cast("string"), F.lit("\1")) for p in parts)), 256)


def short_id(prefix: str, digits: int, *parts: Column) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("\0", *parts), 256), 1, digits))


def first_known(*names: Column) -> Column:
    """The first name that is neither null nor empty."""
    return F.coalesce(*(F.nullif(n, F.lit("")) for n in names))


def composed_name(team: Column, channel: Column) -> Column:
    """Team › Channel, or the one of them that is known."""
    team, channel = F.nullif(team, F.lit("")), F.nullif(channel, F.lit(""))
    return F.when(team.isNotNull() & channel.isNotNull(), F.concat(team, F.lit(" › "), channel)).otherwise(F.coalesce(channel, team))


def member_list_name(names: Column, total: Column) -> Column:
    """Up to three names and how many more there are."""
    known = F.filter(names, lambda x: x.isNotNull() & (x != ""))
    more = total - F.least(F.size(known), F.lit(3))
    return F.when(F.size(known) == 0, F.concat(F.lit("Unnamed ("), total.cast("string"), F.lit(" members)"))).otherwise(
        F.concat(F.array_join(F.slice(known, 1, 3), ", "), F.when(more > 0, F.concat(F.lit(" +"), more.cast("string"))).otherwise(""))
    )


def markup_text(html: Column) -> Column:
    """The text of HTML: scripts, styles and comments dropped, tags to spaces, the five basic references decoded, white space to one space."""
    out = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</(script|style)\s*>|<!--.*?-->", " ")
    out = F.regexp_replace(out, r"<[^>]*>", " ")
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"), ("nbsp", " "), ("amp", "&")):
        out = F.replace(out, F.lit(f"&{name};"), F.lit(char))
    return one_line(out)


def scrubbed(text: Column) -> Column:
    """Without bearer tokens, web tokens, signatures and values of secret keys."""
    out = F.regexp_replace(text, r"(?i)bearer\s+[A-Za-z0-9._~+/=-]+", "Bearer [removed]")
    out = F.regexp_replace(out, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*", "[removed]")
    out = F.regexp_replace(out, r'(?i)([?&](?:sig|tempauth)=)[^&\s"]+', "$1[removed]")
    return F.regexp_replace(out, r'(?i)((?:token|secret|password|api_key|authorization)"?\s*[:=]\s*"?)[^"\s,}]+', "$1[removed]")


def duration_text(seconds: Column) -> Column:
    """1h 02m 03s, 2m 03s or 3s."""
    h, m, s = F.floor(seconds / 3600), F.floor(seconds % 3600 / 60), F.floor(seconds % 60)
    return F.when(h > 0, F.format_string("%dh %02dm %02ds", h, m, s)).when(m > 0, F.format_string("%dm %02ds", m, s)).otherwise(F.format_string("%ds", s))


def deep_link(base: str, *parts: Column) -> Column:
    """A link whose path parts are URL-escaped."""
    return F.concat_ws("/", F.lit(base), *(F.url_encode(p) for p in parts))


def thread_of_link(url: Column) -> Column:
    """The meeting thread id inside a join link, '' where there is none."""
    return F.regexp_extract(F.url_decode(url), r"(19:meeting_[^/@]+@thread\.[a-z0-9]+)", 1)
