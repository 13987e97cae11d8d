"""Template residue and error-page text: recurrent lines subtracted by host, the rest searched for evidence."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notegraph.session import cut_lineage

#: A line is boilerplate of its host when this share of the host's distinct texts has it, and more than one.
BOILERPLATE_SHARE = 0.05
#: A line is served when this share of them has it, three at least, and it has words of ``WORDS_SERVED``.
SERVED_SHARE = 0.0005
#: Recurrent lines up to which they are broadcast; beyond, they are joined by host.
BROADCAST_LINES = 100_000
# Words of pages, notices and templates, in lower case.
WORDS_SERVED = (
    r"\b(?:please|pages?|sites?|website|servers?|requests?|sessions?|access|browsers?|scripts?|javascript|cookies?|errors?|failed|unavailable|maintenance|try again|sign in|log ?in|refresh|reload|click|"
    r"placeholder|lorem|todo|tbd|insert|to be (?:done|written|filled|added)|goes here|this (?:text|section|field)|permission|administrator|robot|captcha|seite|página|veuillez|bitte|por favor|erreur|fehler|navegador|navigateur)\b"
)
#: A text of more words is a notice only by the share of its words in sentences that belong to one.
NOTICE_WORDS, NOTICE_SHARE = 45, 0.75
#: Characters a slot, at most, in a text that its slots make a template.
SLOT_CHARS = 120

_CODE = re.compile(r"^[ ]{0,3}(`{3,}|~{3,})[^\n]*\n.*?(?:^[ ]{0,3}\1[`~]*[ \t]*$|\Z)|<(pre|code)\b[^<>]*>.*?</\2\s*>", re.S | re.M | re.I)
_SPAN = re.compile(r"(`+)(?!`)[^\n]+?(?<!`)\1(?!`)")
_BLOCKS = re.compile(r"\n[ \t]*\n+")
_MARKS = re.compile(r"^[ \t]*(?:#{1,6}[ \t]+|>[ \t]?|[-*+][ \t]+(?:\[[ xX]\][ \t]+)?|\d{1,3}[.)][ \t]+)|[ \t]+$", re.M)
_SENTENCES = re.compile(r"(?<=[.!?])\s+|\n+")
_UNSEEN = re.compile(r"<!--.*?(?:-->|\Z)|<(style|script|title)\b.*?(?:</\1\s*>|\Z)", re.S | re.I)
_FALLBACK = re.compile(r"<noscript\b.*?(?:</noscript\s*>|\Z)", re.S | re.I)
_TAG = re.compile(r"<[^<>]*>")
_LABEL = re.compile(r"^(?:[\w'’-]+[ \t]){0,4}[\w'’-]+:[ \t]+(?=\S)")

# Forms of a place in a template. Each must fill its block (but for a label) to count.
_PLACE = "|".join(
    (
        r"\{\{\{?[^{}\n]{1,80}\}?\}\}", r"\{%[^%\n]{1,120}%\}", r"<%[=-]?[^%\n]{1,120}%>", r"\$\{[\w.]{1,60}\}", r"\$\([A-Za-z_]\w{0,40}\)", r"%%?[A-Za-z]\w{1,40}%%?", r"@@\w{2,40}@@",
        r"<<\s?\w[\w -]{0,40}\s?>>", r"#\w{0,40}PLACEHOLDER\w{0,40}#", r"__\w{2,40}__", r"\[\[?(?:insert|enter|add|your|fill|todo|tbd|placeholder|describe|write)\b[^\[\]\n]{0,100}\]\]?",
        r"\[[^\[\]\n]{1,60}\b(?:to be (?:filled in|added|written|done|completed|defined)|goes here|placeholder|here)\]", r"<(?:your|insert|enter|add|fill|describe|placeholder)\b[^<>\n]{0,100}>",
        r"\[[A-Z][A-Z0-9_ ]{2,40}\]", r"\[(?:your|the)? ?[\w ]{1,40} (?:name|title|text|date|here)\]", r"%\([A-Za-z_]\w{0,40}\)[sd]", r"\{\d{1,2}\}", r"«[A-Za-z_ ]{2,40}»", r"\*{2,3}[A-Z_]{3,40}\*{2,3}", r"_{5,}", r"~~?[A-Z_]{3,40}~~?", r"<[A-Z][A-Z_ ]{2,40}>",
        r"\{(?:your|insert|enter|add|fill|describe|content|text)\b[^{}\n]{0,140}\}", r"\{[^{}\n,]{1,60}\b(?:goes here|to be filled in|placeholder|here)\}", r"\{[A-Za-z]+(?:_[A-Za-z]+)*\}",
    )
)
#: What a place can begin with.
_OPENING = re.compile(r"[{<%$@#_\[«*~]")
_ONLY_PLACES = re.compile(rf"(?:(?:{_PLACE})[\s.,;:!?–—-]*)+", re.I)
_GREETING = re.compile(r"(?:dear|hello|hi|hey|liebe[r]?|estimad[oa]|cher|chère)\s+(?:" + _PLACE + r").{0,200}", re.I | re.S)
_SLOT = re.compile(r"\{[A-Za-z]+_[A-Za-z_]+\}|\{\{[^{}\n]+\}\}|<<\w+>>|%%\w+%%|@@\w+@@|\[[A-Z][A-Z_ ]{2,30}\]")
_STUBS = re.compile(
    r"\((?:describe|explain|add|insert|write|summari[sz]e|fill in|enter|state|list)\b[^()\n]{3,140}\)|(?:replace|overwrite) this (?:text|line|paragraph|section)\b.{0,80}|"
    r"(?:todo|tbd|fixme|tbc|xxx)\b[ :.-]*(?:(?:write|add|fill|describe|complete|finish|insert|replace|explain)\b.{0,100})?|(?:to be (?:done|filled in|written|added|completed|announced|determined))\.?|"
    r"untitled(?: (?:section|note|page|document|heading))?\.?(?: click .{0,60})?|click (?:here )?to (?:edit|add|enter)\b.{0,60}|(?:x{3,})(?:[ \t]+\w+(?:[ _]\w+)?)?[ \t]+x{3,}|x{4,}|(?:lorem[. ]*)+|"
    r"(?:insert|enter|add|put|paste|write|type)\b[^\n.]{2,80}\bhere\b[.!]?|(?:this|the) (?:section|field|page|note|text|paragraph) (?:is|was|has been)? ?(?:intentionally )?(?:left )?(?:blank|empty|not (?:yet )?(?:been )?(?:filled in|written|completed))\b.{0,60}|(?:no|missing) (?:content|description|summary|text) (?:yet|available|provided|given)\.?|"
    r"(?:YYYY|JJJJ|AAAA)-MM-(?:DD|TT)\b(?:[ ,;|]+[\w -]{1,30}){0,6}|(?:your|enter|insert|type) (?:\w+ ){0,4}(?:text|name|title|description|content|summary) here\.?|n/?a|\.{3,}|\?{3,}|coming soon\.?|text goes here\.?|placeholder(?: text)?\.?",
    re.I,
)

# Words of filler text, Latin-like and otherwise.
_LATIN = frozenset("lorem ipsum dolor dolum sit amet consectetur consequat adipiscing elit sed eiusmod tempor incididunt labore dolore magna aliqua aliquam enim minim veniam quis nostrud ullamco laboris nisi nulla pariatur excepteur sint occaecat cupidatat sunt culpa officia deserunt mollit anim laborum quam metus umbrae orem opsum".split())
_SPEECH = frozenset("the of and to in a is that it for on was with by this which der die das und ist nicht ein eine le les des et est que dans pour el los las una es con para".split())
_FILLER = re.compile(r"(?:(?:foo|bar|baz|qux|blah?|asdf|qwerty|test|dummy|lorem|ipsum|abc|xyz)[\s,.;]*){4,}|(?:this is (?:a |some )?(?:sample|dummy|test|example|placeholder|filler) (?:text|content|sentence|paragraph)\b[^.\n]{0,60}\.?\s*){1,}|(?:the quick brown fox jumps over the lazy dog\.?\s*)+", re.I)

# Reason phrases of served status lines.
_REASON = r"(?:bad request|unauthori[sz]ed|payment required|forbidden|not found|method not allowed|not acceptable|request time-?out|conflict|gone|too many requests|internal server error|not implemented|bad gateway|service (?:temporarily )?unavailable|gateway time-?out|access denied|page not found)"
_STATUS = re.compile(
    rf"HTTP/\d(?:\.\d)?[ \t]+[1-5]\d\d\b.*|(?:error|http|status|fehler|erreur)?[ \t:#-]*[45]\d\d[ \t:.–—-]+(?:error[ \t:.-]+)?{_REASON}\b.{{0,160}}|{_REASON}[. ]*|(?:error|fehler|erreur)[ \t:#]*[45]\d\d\b.{{0,60}}|"
    rf"(?:<!doctype\b[^<>]*>\s*)?<html\b.*<title>[^<]*(?:[45]\d\d|error|not found|denied|unavailable)[^<]*</title>.*|<div class=[\"'][^\"']*\berror\b[^\"']*[\"']>.*|"
    r"\{\s*\"(?:error|errors|status|code|message|fault)\"\s*:.*(?:[45]\d\d|error|denied|not found|unavailable).*\}|<\?xml\b.*<(?:error|fault)\b.*|"
    r"(?:fatal error|uncaught (?:type|reference|syntax)?error|exception in thread|segmentation fault|internal error|proxy error|dns error|database (?:connection )?error|error establishing a database connection)\b.*|(?:warning|notice|fatal error): .{0,200} (?:in|on line) .*|err_[a-z_]{4,40}\b.{0,80}|(?:nginx|apache|cloudflare|varnish)(?:/[\d.]+)?\b.{0,80}|the requested (?:url|resource|page)\b.{0,160}|"
    r"upstream (?:connect error|request timeout|timed out)\b.*|(?:no healthy upstream|connection (?:refused|reset by peer|timed out))\b.{0,120}|traceback (?:id|\(most recent)\b.*|default backend - 404",
    re.I | re.S,
)
# What notices say, searched in lower case.
_FAULT = re.compile(
    r"can(?:['’]t|not) (?:find|be found|reach|open|display|load|render)|could not (?:be (?:found|served|reached|loaded)|render|load|find)|(?:page|site|note|entry|resource|link)\b.{0,40}(?:not found|no longer (?:exists|available)|moved or deleted|does(?:n['’]t| not) exist)|"
    r"something went wrong|an? (?:unexpected |internal |unknown )?error (?:has )?occurred|(?:request|connection|access) (?:was |has been |is )?(?:blocked|refused|rejected|reset|timed out|forbidden)|back soon|be right back|under construction|overloaded|at capacity|could not be (?:processed|completed|verified)|not a robot|you are human|(?:link|token|page) (?:has |is )?expired|required to (?:log|sign) in|"
    r"went wrong|access (?:is )?denied|do not have (?:permission|access)|not authori[sz]ed|session (?:has )?(?:expired|timed out)|(?:down|closed|offline) for (?:scheduled |planned )?maintenance|temporarily unavailable|service (?:is )?unavailable|"
    r"unusual traffic|too many requests|rate limit exceeded|security check|captcha|nicht gefunden|introuvable|no (?:se ha )?encontrad[ao]|verschoben oder gelöscht|zugriff verweigert|accès refusé|acceso denegado|wartungsarbeiten|expirée?|caducado",
)
_NOTICE = re.compile(r"java ?script|\bscripts?\b|\bcookies?\b|\bbrowser\b|\bnavegador\b|\bnavigateur\b|ad-?blocker|\bdns\b|\bwebgl\b|\blocal storage\b")
_ADDRESS = re.compile(
    r"\bplease\b|\byou(?:r)?\b|\bwe (?:are|can(?:['’]t|not)|could)\b|\boops\b|\bsorry\b|\bcheck back\b|\bsign in\b|\blog in\b|\btry again\b|\brefer?(?:ence)?[ :]+[0-9a-f]{4,}|\brequest id\b|\badministrator\b|\bgo back\b|\bcomplete the check\b|\bthis (?:site|page|app|website)\b|"
    r"\bbitte\b|\bsie\b|\bveuillez\b|\bvotre\b|\bvous\b|\besta (?:página|web)\b|\bsu navegador\b|\bvuelva\b|\bpor favor\b|\bder eintrag\b|\bdie seite\b|\bla page\b|\bla página\b|\btake(?:s)? a few seconds\b|\bswitch (?:them|it) on\b|\bturn (?:them|it) on\b",
)
_DEMAND = re.compile(
    r"\b(?:enable|activate|allow|turn(?:ed)? on|switch(?:ed)? (?:on|off)|needs?|requires?|required|must|works? best|blocks?|disabled?|checking|continue|reload|supported|outdated|update|upgrade)\b|aktivieren|einschalten|activez|activer|active(?:lo|r)?|necesita|nécessite|benötigt|recargar|cargar",
)


def normal_line(line: Column) -> Column:
    """A line as it is counted: lower case, digits as 0, blanks as one."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), r"\p{Nd}+", "0"), r"[\s\u00a0]+", " "))


def _normal(line: str) -> str:
    return " ".join(re.sub(r"\d+", "0", line.lower()).split())


def recurrent_lines(df: DataFrame, text: str, host: str, share: float = BOILERPLATE_SHARE, served: float = SERVED_SHARE) -> DataFrame:
    """``(host, line, boilerplate)``: normalised lines that recur in a host's distinct texts. Those that ``share`` of the
    texts have are its boilerplate; those that ``served`` of them have, three at least, and that speak of pages, scripts,
    sessions or places to fill (``WORDS_SERVED``) in four words or more, are served by a machine.

    Copies of one text count once, so that a page served under many keys is not taken for lines that many texts share.
    Texts are told apart and lines counted by their hashes, so bodies do not travel; only lines that recur are looked up
    again, at most (lines a text) / ``served`` of a host.
    """
    lines = F.filter(F.array_distinct(F.transform(F.split(text, r"\r\n|\r|\n"), normal_line)), lambda x: F.length(x) > 0)
    rows = df.where(F.col(text).isNotNull()).select(F.col(host).alias("host"), F.xxhash64(text, F.lit(1)).alias("_a"), F.xxhash64(F.reverse(text)).alias("_b"), lines.alias("_lines"))
    texts = rows.select("host", "_a", "_b", F.transform("_lines", lambda x: F.xxhash64(x)).alias("_lines")).dropDuplicates(["host", "_a", "_b"])
    texts = cut_lineage(texts.select("host", "_lines"))
    counts = texts.select("host", F.explode("_lines").alias("_l")).groupBy("host", "_l").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    totals = texts.groupBy("host").agg(F.count(F.lit(1)).alias("_total")).withColumnRenamed("host", "_h")
    often = counts.join(F.broadcast(totals), F.col("host").eqNullSafe(F.col("_h"))).where((F.col("n") >= F.col("_total") * min(share, served)) & ((F.col("n") >= F.col("_total") * share) | (F.col("n") >= 3)))
    often = often.select(F.col("host").alias("_h"), F.col("_l"), (F.col("n") >= F.col("_total") * share).alias("boilerplate"))
    named = rows.select("host", F.explode("_lines").alias("line")).withColumn("_k", F.xxhash64("line"))
    found = named.join(often, F.col("host").eqNullSafe(F.col("_h")) & (F.col("_k") == F.col("_l"))).select("host", "line", "boilerplate").distinct()
    return found.where(F.col("boilerplate") | (F.col("line").rlike(WORDS_SERVED) & (F.size(F.split("line", " ")) >= 4)))


def evidence(block: str) -> str | None:
    """``placeholder``, ``filler``, ``error`` or ``script`` if a block is nothing else; None for ordinary text.

    The whole block must be residue, but for a label before it: text that writes about such things is not.
    """
    forms = [block.strip()]
    forms.append(_MARKS.sub("", forms[0]).strip())
    forms.append(_LABEL.sub("", forms[1]).strip())
    for form in dict.fromkeys(forms):
        if found := _matched(form):
            return found
    return _filler(forms[2]) or _notice(forms[2].lower()) if forms[2] else None


def _filler(text: str) -> str | None:
    low = text.lower()
    words = re.findall(r"[^\W\d_]+", low) if _SPEECH.isdisjoint(low.split()) else []
    if len(words) >= 6 and _SPEECH.isdisjoint(words):
        latin = sum(w in _LATIN for w in words)
        if (latin >= 3 or words[:2] == ["lorem", "ipsum"]) and latin >= 0.12 * len(words):
            return "filler"
    return "filler" if _FILLER.fullmatch(text) else None


def _matched(text: str) -> str | None:
    """The kind of a text that has a form of residue from end to end."""
    if not text:
        return None
    if _ONLY_PLACES.fullmatch(text) or _STUBS.fullmatch(text) or _GREETING.fullmatch(text):
        return "placeholder"
    slots = len(_SLOT.findall(text))
    if slots >= 2 and len(text) < SLOT_CHARS * slots:
        return "placeholder"
    if _noscript_page(text):
        return "script"
    return "error" if _STATUS.fullmatch(text) else None


def _noscript_page(text: str) -> bool:
    """Whether what a block shows is for the greater part the fallback for readers without scripts."""
    if "<" not in text or "<noscript" not in text.lower():
        return False
    shown = _UNSEEN.sub(" ", text)
    inside = sum(len(_TAG.sub(" ", x).split()) for x in _FALLBACK.findall(shown))
    return inside > len(_TAG.sub(" ", _FALLBACK.sub(" ", shown)).split())


def _notice(text: str) -> str | None:
    """``script`` or ``error`` if a lower-case text is a notice to the reader: up to ``NOTICE_WORDS`` words if it says so anywhere,
    beyond if it begins so and ``NOTICE_SHARE`` of its words stand in sentences that belong to such a notice."""
    long = len(text.split(None, NOTICE_WORDS + 1)) > NOTICE_WORDS
    said = " ".join([x for x in _SENTENCES.split(text, 8) if x.strip()][:2]) if long else text
    if not _ADDRESS.search(said):
        return None
    found = "script" if _NOTICE.search(said) and _DEMAND.search(said) else "error" if _FAULT.search(said) else None
    if found and long:
        sentences = [x for x in _SENTENCES.split(text) if x.strip()]
        words = [len(x.split()) for x in sentences]
        about = sum(n for n, x in zip(words, sentences) if _told(x))
        return found if about >= NOTICE_SHARE * sum(words) else None
    return found


def _told(text: str) -> bool:
    """Whether a lower-case text has words of a notice."""
    return bool(_FAULT.search(text) or _NOTICE.search(text) or _ADDRESS.search(text))


def _blocks(text: str) -> list[str]:
    return [b for b in _BLOCKS.split(text) if b.strip()]


def _places(block: str) -> bool:
    """Whether a line of a block is an unfilled place."""
    lines = block.split("\n") if _OPENING.search(block) else []
    if len(lines) > 1:
        for line in lines:
            stripped = _MARKS.sub("", line).strip()
            if stripped and (_ONLY_PLACES.fullmatch(stripped) or _ONLY_PLACES.fullmatch(_LABEL.sub("", stripped))):
                return True
    return False


def _recurrent_kind(text: str, bare: bool) -> str | None:
    """The kind of residue a text has although lines of it recur: unfilled places and filler are residue however many
    texts have them; a notice or status line is where it is all there is. ``bare``: no line is the text's own."""
    blocks = _blocks(text)
    found = [evidence(b) for b in blocks]
    for block, kind in zip(blocks, found):
        if kind in ("placeholder", "filler"):
            return kind
        if _places(block):
            return "placeholder"
    kinds = [k for k in found if k]
    if kinds and (len(kinds) == len(found) or (bare and all(k or _told(b.lower()) for b, k in zip(blocks, found)))):
        return kinds[0]
    return None


def residue_kind(body: str | None, common: frozenset[str] = frozenset(), served: frozenset[str] = frozenset()) -> str | None:
    """The kind of residue a body has, as a whole or in one of its blocks, after boilerplate lines are subtracted; what
    is residue whether or not it recurs is judged before. A block of nothing but ``served`` lines is residue too."""
    if not body or body.isspace():
        return None
    text = _SPAN.sub(" \x00 ", _CODE.sub("\n\n", body.replace("\r\n", "\n").replace("\r", "\n")))
    if common:
        lines = text.split("\n")
        own = [x for x in lines if _normal(x) not in common]
        if len(own) < len(lines):
            if found := _recurrent_kind(text, not any(x.strip() for x in own)):
                return found
            text = "\n".join(own)
    blocks = _blocks(text)
    if found := evidence(text):
        return found
    for block in blocks:
        if found := evidence(block):
            return found
        if _places(block):
            return "placeholder"
        if served and all(_normal(x) in served for x in block.split("\n") if x.strip()):
            low = block.lower()
            return "script" if _NOTICE.search(low) else "error" if _told(low) else "placeholder"
    return None


def find_residue(df: DataFrame, key: str, text: str, host: str) -> DataFrame:
    """``(key, residue)`` for every distinct row: the kind of residue its text has, null if none.

    Null, empty and blank texts have none. Lines are counted per ``host`` (null hosts are one host), over distinct texts.
    Code blocks and spans are set aside first: what they show is no residue. Null keys are dropped, exact duplicate rows
    count once, extra columns are ignored. Recurrent lines reach the tasks as one broadcast table of sets by host where
    there are at most ``BROADCAST_LINES``; more are joined to the rows by host.
    """
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"), F.col(host).cast("string").alias("host"))
    lines = cut_lineage(recurrent_lines(rows, "text", "host"))
    kind = df.schema[key].dataType.simpleString()
    if lines.count() <= BROADCAST_LINES:
        sets: dict = {}
        for h, line, common in lines.collect():  # at most BROADCAST_LINES
            sets.setdefault(h, (set(), set()))[not common].add(line)
        shared = df.sparkSession.sparkContext.broadcast({h: tuple(map(frozenset, pair)) for h, pair in sets.items()})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                kinds = [residue_kind(body, *shared.value.get(h, ())) for body, h in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kinds, pa.string())], ["key", "residue"])

        judged = rows.mapInArrow(run, f"key {kind}, residue string")
    else:
        own = F.array_distinct(F.transform(F.split("text", r"\r\n|\r|\n"), normal_line))
        per = lines.groupBy("host").agg(F.collect_set(F.when(F.col("boilerplate"), F.col("line"))).alias("common"), F.collect_set(F.when(~F.col("boilerplate"), F.col("line"))).alias("served")).withColumnRenamed("host", "_h")
        joined = rows.join(per, F.col("host").eqNullSafe(F.col("_h")), "left").select("key", "text", F.array_intersect("common", own).alias("common"), F.array_intersect("served", own).alias("served"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                kinds = [residue_kind(*x) for x in zip(batch.column(1).to_pylist(), *([frozenset(v or ()) for v in batch.column(c).to_pylist()] for c in (2, 3)))]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kinds, pa.string())], ["key", "residue"])

        judged = joined.mapInArrow(run, f"key {kind}, residue string")
    return judged.withColumnRenamed("key", key).distinct()
