"""Markup residue: HTML, Markdown, wiki and LaTeX turned to clean text that keeps its structure.

A body is parsed into nodes, each with the path of markup from the root to it. Tag-path ratios (text length and
punctuation per path, smoothed over the document, multiplied, compared with a threshold) select the paths of HTML that
are content. Headings, items, code, tables, formulas and link texts are kept as such, but for those of navigation,
footers and lists of links, which have to pass the threshold like the rest.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.entities import html5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("html", "markdown", "wiki", "latex")

# The element names of HTML.
_TAGS = (
    "a abbr acronym address applet area article aside audio b base bdi bdo big blockquote body br button canvas caption center cite code col colgroup data "
    "datalist dd del details dfn dialog dir div dl dt em embed fieldset figcaption figure font footer form frame frameset h1 h2 h3 h4 h5 h6 head header hgroup "
    "hr html i iframe img input ins kbd label legend li link main map mark menu meta meter nav noframes noscript object ol optgroup option output p param "
    "picture pre progress q rp rt ruby s samp script section select small source span strike strong style sub summary sup svg table tbody td template textarea "
    "tfoot th thead time title tr track tt u ul var video wbr"
).split()
_INLINE = frozenset("a abbr acronym b bdi bdo big cite del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())

_TAG = re.compile(r"(?<!<)<(/?)(" + "|".join(sorted(_TAGS, key=len, reverse=True)) + r")(\s[^<>]*|/)?>(?!>)", re.I)
_COMMENT = re.compile(r"<!--.*?-->|<!doctype[^>]*>|<!\[CDATA\[.*?\]\]>", re.I | re.S)
_RAW = re.compile(r"(?<!<)<(pre|code|script|style|textarea)(?:\s[^<>]*)?>(.*?)</\1\s*>", re.I | re.S)
_ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});")
_SPAN = re.compile(r"(?<!`)(`+)(?!`)(.+?)(?<!`)\1(?!`)", re.S)
_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})[^`\n]*$")
_ATX = re.compile(r"^ {0,3}(#{1,6})[ \t]+(\S.*?)(?:[ \t]+#+)?[ \t]*$")
_SETEXT = re.compile(r"^ {0,3}(={3,}|-{3,})[ \t]*$")
_WIKI_HEAD = re.compile(r"^[ \t]*(={2,6})[ \t]*([^=\s](?:.*?[^=\s])?)[ \t]*\1[ \t]*$")
_ITEM = re.compile(r"^([ \t]*)(?:[-*+][ \t]+(?:\[[ xX]\][ \t]+)?|\d{1,3}[.)][ \t]+)(\S.*)$")
_QUOTE = re.compile(r"^ {0,3}>[ \t]?(.*)$")
_DELIMITER = re.compile(r"^[ \t]*\|?[ \t]*:?-{1,}:?[ \t]*(?:\|[ \t]*:?-{1,}:?[ \t]*)+\|?[ \t]*$|^[ \t]*\|[ \t]*:?-{1,}:?[ \t]*\|[ \t]*$")
_RULE = re.compile(r"^ {0,3}(?:(?:-[ \t]*){3,}|(?:\*[ \t]*){3,}|(?:_[ \t]*){3,})$")

_ENVIRONMENT = re.compile(r"\\begin\{([A-Za-z]+\*?)\}(.*?)\\end\{\1\}", re.S)
_DISPLAY = re.compile(r"\$\$(.+?)\$\$|\\\[(.+?)\\\]", re.S)
_FORMULA = re.compile(r"\\\((.+?)\\\)|(?<![\\$\w])\$(?=[^\s$])([^$\n]*?[^\s$\\])\$(?![\d$])", re.S)
_MATHS = re.compile(r"[\\^_{}=<>+]|^[A-Za-z]$|\w\s*[-*/]\s*\w")
_COMMAND = re.compile(r"\\(?:[A-Za-z]+\*?(?:\[[^\]\n]*\])?\{|(?:item|alpha|beta|gamma|delta|epsilon|lambda|mu|pi|sigma|theta|omega|sum|int|prod|infty|partial|nabla|cdot|times|leq?|geq?|neq?|approx|rightarrow|maketitle|newline|noindent|ldots|dots|par|LaTeX|TeX|quad|clearpage|newpage|tableofcontents)(?![A-Za-z\\./:])|[%$&#_](?=\s|\w|$))")
_COMMAND_TEXT = re.compile(r"\\([A-Za-z]+)\*?(?:\[[^\]\n]*\])?\{([^{}]*)\}")
_VERBATIM = frozenset(("verbatim", "verbatim*", "lstlisting", "minted", "alltt"))
_FORMULAS = frozenset(("equation", "equation*", "align", "align*", "gather", "gather*", "multline", "multline*", "eqnarray", "eqnarray*", "math", "displaymath"))

_IMAGE = re.compile(r"!\[([^\[\]\n]*)\]\(([^()\s]+)(?:\s+\"[^\"\n]*\")?\)")
_LINK = re.compile(r"(?<!!)\[([^\[\]\n]+)\]\(([^()\s]+)(?:\s+\"[^\"\n]*\")?\)")
_AUTOLINK = re.compile(r"<((?:https?|ftp|mailto):[^<>\s]+)>")
_STRIKE = re.compile(r"(?<!~)~~(?=[^\s~])(.+?)(?<=[^\s~])~~(?!~)")
_STRONG = re.compile(r"(?<![\w*])\*\*(?=[^\s*])(.+?)(?<=[^\s*])\*\*(?![\w*])|(?<![\w_])__(?=[^\s_])(.+?)(?<=[^\s_])__(?![\w_])")
_EMPHASIS = re.compile(r"(?<![\w*\\])\*(?=[^\s*])([^*\n]*?)(?<=[^\s*])\*(?![\w*])|(?<![\w_\\])_(?=[^\s_])([^_\n]*?)(?<=[^\s_])_(?![\w_])")
_WIKI_LINK = re.compile(r"\[\[([^\[\]|\n]+)(?:\|([^\[\]\n]*))?\]\]")
_EXTERNAL = re.compile(r"(?<!\[)\[((?:https?|ftp):\/\/[^\s\]]+)[ \t]+([^\[\]\n]+)\]")
_WIKI_MARK = re.compile(r"(?<!')('''''|'''|'')(?!')(?=\S)(.+?)(?<=[^\s'])\1(?!')")
_WIKI_TABLE = re.compile(r"^[ \t]*\{\|.*?^[ \t]*\|\}[ \t]*$", re.S | re.M)
_ANCHOR = re.compile(r"<a\b[^<>]*>(.*?)</a\s*>", re.I | re.S)
# HTML elements that frame a page, and those whose text is judged.
_CHROME = frozenset("nav footer menu form select aside header button".split())
_BOXES = _CHROME | frozenset("div section td article main".split())
_PUNCTUATION = re.compile(r"[.,;:!?。，；：！？]")


@dataclass
class Node:
    """A leaf: its markup path, its text as it is to be kept, whether it has a structure of its own, how many of its
    characters are link text, and whether it holds links, code or formulas."""

    path: str
    text: str
    structural: bool = False
    code: bool = False
    linked: int = 0
    held: bool = False


@dataclass
class Parsed:
    nodes: list[Node] = field(default_factory=list)
    kinds: set[str] = field(default_factory=set)


def parse(body: str) -> Parsed:
    """Nodes and kinds of markup of a body. Inside code nothing but the code's own markup counts."""
    out = Parsed()
    kept: list[str] = []

    def keep(text: str) -> str:
        kept.append(text)
        return f"\x00{len(kept) - 1}\x01"

    text = body.replace("\r\n", "\n").replace("\r", "\n").replace("\x00", "").replace("\x01", "")
    text = _fences(text, out, keep)
    if "<" in text:
        text = _RAW.sub(lambda m: _raw(m, out, keep), text)
    if "\\begin{" in text:
        text = _ENVIRONMENT.sub(lambda m: _environment(m, out, keep), text)
    if "`" in text:
        text = _SPAN.sub(lambda m: _code_span(m, out, keep), text)
    if "$" in text or "\\" in text:
        text = _DISPLAY.sub(lambda m: _formula(m, out, keep, "$$"), text)
        text = _FORMULA.sub(lambda m: _formula(m, out, keep, "$"), text)
    if "{|" in text:
        text = _WIKI_TABLE.sub(lambda m: _wiki_table(m, out, keep), text)
    text = _COMMENT.sub(lambda m: _said(out, "html", ""), text)
    _blocks(text, out, kept)
    return out


def _said(out: Parsed, kind: str, text: str) -> str:
    out.kinds.add(kind)
    return text


def _fences(text: str, out: Parsed, keep) -> str:
    if "```" not in text and "~~~" not in text:
        return text
    lines, done, at = text.split("\n"), [], 0
    while at < len(lines):
        m = _FENCE.match(lines[at])
        if not m:
            done.append(lines[at])
            at += 1
            continue
        mark, end = m[1], at + 1
        close = re.compile(r"^ {0,3}" + re.escape(mark[0]) + "{" + str(len(mark)) + r",}[ \t]*$")
        while end < len(lines) and not close.match(lines[end]):
            end += 1
        out.kinds.add("markdown")
        done += ["", keep("C" + "\n".join(lines[at + 1 : end])), ""]
        at = end + 1
    return "\n".join(done)


def _raw(m: re.Match, out: Parsed, keep) -> str:
    out.kinds.add("html")
    name = m[1].lower()
    if name in ("script", "style"):
        return ""
    inner = html.unescape(re.sub(r"</?(?:code|span|b|i)(?:\s[^<>]*)?>", "", m[2], flags=re.I))
    if name == "code" and "\n" not in inner:
        return keep("c" + inner)
    return "\n\n" + keep("C" + inner.strip("\n")) + "\n\n"


def _environment(m: re.Match, out: Parsed, keep) -> str:
    out.kinds.add("latex")
    name, inner = m[1], m[2]
    if name in _VERBATIM:
        return "\n\n" + keep("C" + inner.strip("\n")) + "\n\n"
    if name in _FORMULAS:
        return "\n\n" + keep("F" + inner.strip()) + "\n\n"
    if name in ("itemize", "enumerate", "description"):
        items = [i.strip() for i in re.split(r"\\item(?:\[[^\]]*\])?\s*", inner)[1:]]
        return "\n\n" + "\n".join(f"\x02{' '.join(i.split())}" for i in items) + "\n\n"
    if name in ("tabular", "table", "array"):
        rows = [" | ".join(c.strip() for c in r.split("&")) for r in re.split(r"\\\\", re.sub(r"\\hline|^\{[^}]*\}", "", inner)) if r.strip()]
        return "\n\n" + keep("T" + "\n".join(rows)) + "\n\n"
    return "\n\n" + inner + "\n\n"


def _code_span(m: re.Match, out: Parsed, keep) -> str:
    if "\n\n" in m[2]:
        return m[0]
    out.kinds.add("markdown")
    return keep("c" + m[2].strip())


def _formula(m: re.Match, out: Parsed, keep, mark: str) -> str:
    inner = (m[1] if m[1] is not None else m[2]).strip()
    bare = m[0].startswith("$") and not m[0].startswith("$$")
    if "\n\n" in inner or (bare and not _MATHS.search(inner)):
        return m[0]
    out.kinds.add("latex")
    return "\n\n" + keep("F" + inner) + "\n\n" if mark == "$$" else keep("f" + inner)


def _wiki_table(m: re.Match, out: Parsed, keep) -> str:
    out.kinds.add("wiki")
    rows: list[list[str]] = [[]]
    for line in m[0].split("\n")[1:-1]:
        line = line.strip()
        if line.startswith("|-"):
            rows.append([])
        elif line[:1] in "|!" and not line.startswith("|+"):
            rows[-1] += [c.strip() for c in re.split(r"\|\||!!", line[1:])]
    return "\n\n" + keep("T" + "\n".join(" | ".join(r) for r in rows if r)) + "\n\n"


def _inline(text: str, out: Parsed) -> str:
    """Text of a node without inline markup; link texts, emphasised words and formulas stay."""
    if "[" in text:
        text = _WIKI_LINK.sub(lambda m: _said(out, "wiki", m[2] or m[1]), text)
        text = _IMAGE.sub(lambda m: _said(out, "markdown", m[1]), text)
        text = _LINK.sub(lambda m: _said(out, "markdown", m[1]), text)
        text = _EXTERNAL.sub(lambda m: _said(out, "wiki", m[2]), text)
    if "<" in text:
        text = _AUTOLINK.sub(lambda m: _said(out, "markdown", m[1]), text)
        text = _TAG.sub(lambda m: _said(out, "html", "\n" if m[2].lower() == "br" else ""), text)
    if "&" in text:
        text = _ENTITY.sub(lambda m: _said(out, "html", html.unescape(m[0])) if m[0][1] == "#" or m[0][1:] in html5 else m[0], text)
    if "\\" in text:
        while _COMMAND_TEXT.search(text):
            text = _COMMAND_TEXT.sub(lambda m: _said(out, "latex", "" if m[1] in ("label", "cite", "ref", "vspace", "hspace") else m[2]), text)
        text = _COMMAND.sub(lambda m: _said(out, "latex", m[0][1:] if m[0][1] in "%$&#_" else ""), text)
    if "''" in text:
        text = _WIKI_MARK.sub(lambda m: _said(out, "wiki", m[2]), text)
    if "~~" in text:
        text = _STRIKE.sub(lambda m: _said(out, "markdown", m[1]), text)
    if "*" in text or "_" in text:
        text = _STRONG.sub(lambda m: _said(out, "markdown", m[1] or m[2]), text)
        text = _EMPHASIS.sub(lambda m: _said(out, "markdown", m[1] or m[2]), text)
    return text


_KEPT = re.compile("\x00(\\d+)\x01")
_LATEX_HEAD = re.compile(r"^\\(?:part|chapter|(?:sub)*section|(?:sub)?paragraph)\*?\{([^{}\n]*)\}[ \t]*$")


def _blocks(text: str, out: Parsed, kept: list[str]) -> None:
    stack: list[str] = []
    lines = text.split("\n")
    buffer: list[str] = []

    def add(path: str, content: str, structural: bool = False, prefix: str = "") -> None:
        whole = _KEPT.fullmatch(content.strip())
        if whole and kept[int(whole[1])][0] in "CFT":
            kind, inner = kept[int(whole[1])][0], kept[int(whole[1])][1:]
            shown = {"C": f"```\n{inner}\n```", "F": f"$$ {inner} $$", "T": inner}[kind]
            out.nodes.append(Node("/".join([*stack, {"C": "code", "F": "formula", "T": "table"}[kind]]), shown, True, kind == "C"))
            return
        clean = _inline(content, out)
        clean = _KEPT.sub(lambda m: {"c": "`{}`", "f": "${}$"}.get(kept[int(m[1])][0], "{}").format(kept[int(m[1])][1:]), clean)
        clean = re.sub(r"[ \t]+", " ", clean).strip()
        if clean:
            linked = sum(len(_TAG.sub("", m[1]).strip()) for m in _ANCHOR.finditer(content)) if "<" in content else 0
            held = linked > 0 or "\x00" in content or "[" in content
            out.nodes.append(Node("/".join([*stack, path]), prefix + clean, structural, linked=linked, held=held))

    def flush() -> None:
        if buffer:
            html_text("\n".join(buffer))
            buffer.clear()

    def html_text(chunk: str) -> None:
        """Splits a paragraph at block-level HTML tags, keeping the stack of open elements."""
        if "<" not in chunk:
            add("p", chunk)
            return
        at = 0
        for m in _TAG.finditer(chunk):
            name = m[2].lower()
            if name in _INLINE or name == "br":
                continue
            leaf(chunk[at : m.start()])
            at = m.end()
            out.kinds.add("html")
            if m[1]:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k] == name or (name[0] == "h" and stack[k][0] == "h" and name[1:].isdigit() and stack[k][1:].isdigit()):
                        del stack[k:]
                        break
            elif name not in _VOID and not (m[3] or "").endswith("/"):
                if name in ("li", "p", "td", "th", "tr", "dt", "dd", "option") and name in stack:
                    del stack[len(stack) - 1 - stack[::-1].index(name) :]
                stack.append(name)
        leaf(chunk[at:])

    def leaf(content: str) -> None:
        if not content.strip():
            return
        top = next((s for s in reversed(stack) if s not in _INLINE), "")
        if re.fullmatch(r"h[1-6]", top):
            add("", content, True, "#" * int(top[1]) + " ")
        elif top in ("li", "dt", "dd"):
            add("", content, True, "- ")
        elif top in ("td", "th"):
            add("", content, True)
        else:
            add("p", content)

    at = 0
    while at < len(lines):
        line = lines[at]
        below = lines[at + 1] if at + 1 < len(lines) else ""
        if not line.strip():
            flush()
        elif line[0] == "\x02":
            flush()
            add("latex:item", line[1:], True, "- ")
        elif m := _ATX.match(line):
            flush()
            add(f"md:h{len(m[1])}", m[2], True, m[1] + " ")
            out.kinds.add("markdown")
        elif m := _WIKI_HEAD.match(line):
            flush()
            add(f"wiki:h{len(m[1])}", m[2], True, "#" * len(m[1]) + " ")
            out.kinds.add("wiki")
        elif m := _LATEX_HEAD.match(line):
            flush()
            add("latex:h", m[1], True, "# ")
            out.kinds.add("latex")
        elif "|" in line and "|" in below + line and _DELIMITER.match(below):
            flush()
            out.kinds.add("markdown")
            rows = [line]
            at += 1
            while at + 1 < len(lines) and "|" in lines[at + 1] and lines[at + 1].strip():
                at += 1
                rows.append(lines[at])
            for row in rows:
                add("md:table/tr", " | ".join(c.strip() for c in row.strip().strip("|").split("|")), True)
        elif not buffer and _SETEXT.match(below) and not _ITEM.match(line) and not _QUOTE.match(line) and not _RULE.match(line) and not _KEPT.fullmatch(line.strip()):
            add("md:h1" if "=" in below else "md:h2", line, True, "# " if "=" in below else "## ")
            out.kinds.add("markdown")
            at += 1
        elif _RULE.match(line):
            flush()
        elif m := _ITEM.match(line):
            flush()
            out.kinds.add("markdown")
            add("md:ul/li", m[2], True, m[1].replace("\t", "    ") + "- ")
        elif (m := _QUOTE.match(line)) and m[1].strip():
            flush()
            out.kinds.add("markdown")
            add("md:quote", m[1], True, "> ")
        else:
            buffer.append(line)
        at += 1
    flush()


def content_nodes(nodes: list[Node], sigma: float = 1.0, share: float = 0.3, links: float = 0.8) -> list[bool]:
    """Which nodes are content, by fused tag-path ratios, decided for whole paths.

    Per path: characters per node and punctuation per node. Each node has its path's ratios; both series are smoothed
    over the document with a Gaussian and multiplied; a path whose nodes reach, on average, ``share`` of the standard
    deviation is content. A path below it is not if it leads through navigation, a footer or the like, or is a list of
    links in a box: three nodes or more, ``links`` of their characters link text, without punctuation. Elsewhere nodes
    with a structure of their own, links, code or formulas are content whatever their ratio, and so are all nodes outside HTML boxes.
    """
    if not nodes:
        return []
    paths: dict[str, list[int]] = {}
    for i, n in enumerate(nodes):
        paths.setdefault(n.path, []).append(i)
    steps = {p: _BOXES.intersection(p.split("/")) for p in paths}
    if not any(steps.values()):
        return [True] * len(nodes)
    length, marks = np.zeros(len(nodes)), np.zeros(len(nodes))
    for places in paths.values():
        length[places] = sum(len(nodes[i].text) for i in places) / len(places)
        marks[places] = sum(len(_PUNCTUATION.findall(nodes[i].text)) for i in places) / len(places)
    reach = np.arange(-2, 3)
    kernel = np.exp(-(reach**2) / (2 * sigma**2))
    kernel /= kernel.sum()
    fused = np.convolve(np.pad(length, 2, mode="edge"), kernel, "valid") * np.convolve(np.pad(marks, 2, mode="edge"), kernel, "valid")
    limit = share * fused.std()
    keep = [True] * len(nodes)
    for path, places in paths.items():
        if not steps[path]:
            continue
        # The path's own punctuation has to bear what its neighbours lend it.
        if marks[places[0]] > 0 and fused[places].mean() >= limit:
            continue
        text = sum(len(nodes[i].text.removeprefix("- ")) for i in places)
        listed = len(places) >= 3 and marks[places[0]] == 0 and sum(nodes[i].linked for i in places) >= links * text
        for i in places:
            keep[i] = not (_CHROME & steps[path]) and not listed and (nodes[i].structural or nodes[i].held or len(paths) == 1)
    return keep


def clean_text(parsed: Parsed) -> str:
    """The content nodes as text, one per line, paragraphs and blocks apart."""
    out: list[str] = []
    last = ""
    for node, keep in zip(parsed.nodes, content_nodes(parsed.nodes)):
        if keep:
            tight = last == node.path and node.structural and not node.code
            out.append(node.text if tight or not out else "\n" + node.text)
            last = node.path
    return "\n".join(out)


def clean_markup(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, text, kinds, n_nodes, n_dropped)``: clean text of every row, the sorted kinds of markup it had, and how many
    of its nodes were left out as no content. Narrow, no shuffle.

    Null texts stay null with no kinds, empty ones stay empty. Text that only resembles markup (a comparison, a price,
    a path, a placeholder) is left as it is. Null keys are dropped; extra columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts: list[str | None] = []
            kinds: list[list[str]] = []
            sizes: list[tuple[int, int]] = []
            for t in batch.column(1).to_pylist():
                parsed = parse(t) if t else Parsed()
                texts.append(clean_text(parsed) if t else t)
                kinds.append(sorted(parsed.kinds))
                sizes.append((len(parsed.nodes), content_nodes(parsed.nodes).count(False)))
            counts = [pa.array([n[j] for n in sizes], pa.int32()) for j in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(kinds, pa.list_(pa.string())), *counts], ["key", "text", "kinds", "n_nodes", "n_dropped"])

    kind = df.schema[key].dataType.simpleString()
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"key {kind}, text string, kinds array<string>, n_nodes int, n_dropped int").withColumnRenamed("key", key)
