"""Text expressions: tokens, slugs, titles, frontmatter and the translation of ASCII word borders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that are no index terms.
STOPWORDS = "a an and are as at be by for from has he in is it its of on or that the to was were will with".split()

_START, _END = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
#: White space as Unicode has it; Java's ``\s`` is ASCII only.
BLANK = r"[\s\u00a0\u1680\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]"


def borders(pattern: str) -> str:
    """A pattern whose ``\\b`` are ASCII word borders and whose ``\\s`` is Unicode white space, for Java regexes.

    A border is an end of word after a word character or a group, and a start of word elsewhere.
    """
    out, at = "", 0
    while (hit := pattern.find(r"\b", at)) >= 0:
        out += pattern[at:hit]
        out += _END if out and hit > 0 and (out[-1].isalnum() or out[-1] in "?+*)]") else _START
        at = hit + 2
    return (out + pattern[at:]).replace(r"\s", BLANK)


def tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits, two or more long, without stopwords; null text has none."""
    runs = F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+")
    return F.filter(runs, lambda t: (F.length(t) >= 2) & ~t.isin(STOPWORDS))


def slug(title: Column) -> Column:
    """Lower case, letters, digits and dashes kept, blanks to dashes."""
    kept = F.regexp_replace(F.lower(title), rf"(?:(?!{BLANK})[^a-z0-9-])", "")
    kept = F.regexp_replace(kept, f"^{BLANK}+|{BLANK}+$", "")
    return F.regexp_replace(kept, f"{BLANK}+", "-")


def inbox_name(title: Column, agent: Column | None = None) -> Column:
    """The file name of an inbox note: the slug of its title, after the agent's name if there is one."""
    name = F.concat(slug(title), F.lit(".md"))
    return name if agent is None else F.when(F.length(agent) > 0, F.concat(agent, F.lit("-"), name)).otherwise(name)


def is_first_run(identity: Column) -> Column:
    """Whether an identity text is still that of the template: null, marked as such, or nothing but headings, comments
    and blanks after its frontmatter."""
    stripped = F.regexp_replace(without_frontmatter(identity), r"(?m)^#+\s.*$|(?s:<!--.*?-->)", "")
    return identity.isNull() | identity.contains("<!-- First session:") | (F.length(F.regexp_replace(stripped, f"{BLANK}+", "")) == 0)


def title_of_path(path: Column) -> Column:
    """The last part of a path without ``.md``, dashes as blanks."""
    stem = F.regexp_replace(F.element_at(F.split(path, r"[/\\]"), -1), r"\.md$", "")
    return F.translate(stem, "-", " ")


def without_frontmatter(content: Column) -> Column:
    """A text without a leading ``---`` ... ``---`` part."""
    return F.regexp_replace(content, r"^---\r?\n[\s\S]*?\r?\n---(?:\r?\n|$)", "")


def matches(text: Column, patterns: list[str], flags: str = "(?i)") -> Column:
    """How many of the patterns a text matches; 0 for null."""
    hit = [F.coalesce(text.rlike(flags + borders(p)).cast("int"), F.lit(0)) for p in patterns]
    return sum(hit[1:], hit[0])
