"""Text of files by format (SRC-3..SRC-8), on the standard library; PDF where an optional package is there.

An extractor returns text and never raises: what can't be read has an empty text and an error.
"""

from __future__ import annotations

import html
import html.parser
import io
import re
import zipfile

_BLOCK = frozenset("p div br li tr h1 h2 h3 h4 h5 h6 section article header footer ul ol table blockquote pre".split())
_SKIP = frozenset("script style title noscript template".split())
#: What a head may hold; any other element begins the body.
_HEAD = frozenset("base link meta script style title noscript template head html".split())


class _Text(html.parser.HTMLParser):
    def __init__(self, links: bool, skip: frozenset = _SKIP):
        super().__init__(convert_charrefs=True)
        self.links, self.skip, self.depth, self.out, self.href = links, skip, 0, [], []
        self.head = False

    def handle_starttag(self, tag, attrs):
        if self.head and tag not in _HEAD:
            self.head, self.depth = False, 0
        elif tag == "head":
            self.head = True
        if tag in self.skip:
            self.depth += 1
        elif tag in _BLOCK:
            self.out.append("\n")
        if tag == "a" and self.links:
            self.href.append(dict(attrs).get("href") or "")
            self.out.append("[")

    def handle_endtag(self, tag):
        if tag == "head":
            self.head, self.depth = False, 0
        if tag in self.skip:
            self.depth = max(0, self.depth - 1)
        elif tag in _BLOCK:
            self.out.append("\n")
        if tag == "a" and self.links and self.href:
            self.out.append(f"]({self.href.pop()})")

    def handle_data(self, data):
        if not self.depth and not self.head:
            self.out.append(data)

    def text(self) -> str:
        lines = (" ".join(x.split()) for x in "".join(self.out).split("\n"))
        return "\n".join(x for x in lines if x)


def html_text(data: bytes, links: bool = True) -> str:
    parser = _Text(links)
    parser.feed(data.decode("utf-8", "replace"))
    parser.close()
    return parser.text()


def _inline(text: str) -> str:
    """Code spans, images, links and emphasis as elements; the rest escaped."""
    spans: list[str] = []

    def code(m) -> str:
        spans.append(f"<code>{html.escape(m[2].strip(), quote=False)}</code>")
        return f"\0{len(spans) - 1}\0"

    text = html.escape(re.sub(r"(`+)(.+?)\1", code, text), quote=False)
    text = re.sub(r"!\[([^\]]*)\]\(([^)\s]*)[^)]*\)", r'<img alt="\1" src="\2">', text)
    text = re.sub(r"\[([^\]]*)\]\(([^)\s]*)[^)]*\)", r'<a href="\2">\1</a>', text)
    text = re.sub(r"&lt;(https?://[^\s&]+)&gt;", r'<a href="\1">\1</a>', text)
    for mark, tag in ((r"\*\*", "strong"), ("__", "strong"), ("~~", "del"), (r"\*", "em"), (r"(?<!\w)_", "em")):
        end = mark.replace("(?<!", "(?!").replace("(?!\\w)_", "_(?!\\w)")
        text = re.sub(rf"{mark}(?=\S)(.+?)(?<=\S){end}", rf"<{tag}>\1</{tag}>", text)
    return re.sub("\0(\\d+)\0", lambda m: spans[int(m[1])], text)


_ITEM = re.compile(r"(\s*)(?:[-*+]|(\d+)[.)])\s+(.*)")
_RULE = re.compile(r"\s{0,3}(?:\|?\s*:?-+:?\s*)(?:\|\s*:?-+:?\s*)*\|?\s*")


def _cells(line: str, tag: str) -> str:
    return "<tr>" + "".join(f"<{tag}>{_inline(c.strip())}</{tag}>" for c in line.strip().strip("|").split("|")) + "</tr>"


def _list_html(items: list[tuple[int, str, str]]) -> str:
    """(indent, tag, text) -> nested lists."""
    out: list[str] = []
    levels: list[tuple[int, str]] = []
    for indent, tag, text in items:
        while levels and indent < levels[-1][0]:
            out.append(f"</li></{levels.pop()[1]}>")
        if levels and indent <= levels[-1][0] + 1:
            out.append("</li>")
        else:
            out.append(f"<{tag}>")
            levels.append((indent, tag))
        out.append(f"<li>{_inline(text)}")
    return "".join([*out, *[f"</li></{tag}>" for _, tag in reversed(levels)]])


def _markdown_html(text: str) -> str:
    """Headings, fenced code, quotes, nested lists, tables, rules and paragraphs as elements."""
    lines, out, k = text.split("\n"), [], 0
    while k < len(lines):
        line = lines[k]
        if m := re.match(r"\s{0,3}(```+|~~~+)", line):
            end = next((j for j in range(k + 1, len(lines)) if lines[j].strip().startswith(m[1])), len(lines))
            out.append("<pre><code>" + html.escape("\n".join(lines[k + 1 : end]), quote=False) + "</code></pre>")
            k = end + 1
        elif m := re.match(r"\s{0,3}(#{1,6})\s+(.*?)\s*#*$", line):
            out.append(f"<h{len(m[1])}>{_inline(m[2])}</h{len(m[1])}>")
            k += 1
        elif re.fullmatch(r"\s{0,3}([-*_])(\s*\1){2,}\s*", line):
            out.append("<hr>")
            k += 1
        elif line.lstrip().startswith(">"):
            end = next((j for j in range(k, len(lines)) if not lines[j].lstrip().startswith(">")), len(lines))
            out.append("<blockquote>" + _markdown_html("\n".join(re.sub(r"^\s*> ?", "", x) for x in lines[k:end])) + "</blockquote>")
            k = end
        elif _ITEM.fullmatch(line):
            items: list[tuple[int, str, str]] = []
            while k < len(lines) and lines[k].strip():
                if m := _ITEM.fullmatch(lines[k]):
                    items.append((len(m[1].expandtabs(4)), "ol" if m[2] else "ul", m[3]))
                else:
                    items[-1] = (*items[-1][:2], f"{items[-1][2]} {lines[k].strip()}")
                k += 1
            out.append(_list_html(items))
        elif "|" in line and k + 1 < len(lines) and "-" in lines[k + 1] and _RULE.fullmatch(lines[k + 1]):
            end = next((j for j in range(k + 2, len(lines)) if "|" not in lines[j]), len(lines))
            out.append("<table>" + _cells(line, "th") + "".join(_cells(x, "td") for x in lines[k + 2 : end]) + "</table>")
            k = end
        elif line.strip():
            end = next((j for j in range(k + 1, len(lines)) if not lines[j].strip() or re.match(r"\s{0,3}(#{1,6}\s|```|~~~|>)", lines[j])), len(lines))
            body = lines[k:end]
            if len(body) > 1 and re.fullmatch(r"(=+|-+)\s*", body[-1]):
                level = 1 if body[-1][0] == "=" else 2
                out.append(f"<h{level}>{_inline(' '.join(x.strip() for x in body[:-1]))}</h{level}>")
            else:
                out.append(f"<p>{_inline(' '.join(x.strip() for x in body))}</p>")
            k = end
        else:
            k += 1
    return "\n".join(out)


def markdown_text(data: bytes, markup: str = "strip") -> str:
    """``strip``: marks removed; ``html``: blocks and inline marks as elements; ``keep``: as it is."""
    text = data.decode("utf-8", "replace")
    text = re.sub(r"\A---\n.*?\n---\n", "", text, flags=re.S)
    if markup == "keep":
        return text
    if markup == "html":
        return _markdown_html(text)
    text = re.sub(r"```.*?\n(.*?)```", r"\1", text, flags=re.S)
    text = re.sub(r"^\s{0,3}(#{1,6}|>|[-*+]|\d+\.)\s+", "", text, flags=re.M)
    text = re.sub(r"^\s*\|?[\s:|-]*-{3,}[\s:|-]*$", "", text, flags=re.M)
    text = re.sub(r"!?\[\[([^\]|]*\|)?([^\]]*)\]\]", r"\2", text)
    text = re.sub(r"!?\[([^\]]*)\]\([^)]*\)", r"\1", text)
    text = re.sub(r"(\*\*|__|\*|~~|`)(?=\S)(.+?)(?<=\S)\1", r"\2", text)
    return text.replace("|", " ")


def docx_text(data: bytes) -> str:
    """Body paragraphs; tables and headers aren't among them."""
    import xml.etree.ElementTree as ET

    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    body = ET.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml")).find(f"{w}body")
    breaks = {f"{w}tab": "\t", f"{w}br": "\n"}
    return "\n".join("".join(x.text or "" if x.tag == f"{w}t" else breaks.get(x.tag, "") for x in p.iter()) for p in body.findall(f"{w}p"))


def epub_text(data: bytes) -> str:
    """The documents of the package's manifest, in its order."""
    import posixpath
    import xml.etree.ElementTree as ET

    book = zipfile.ZipFile(io.BytesIO(data))
    container = ET.fromstring(book.read("META-INF/container.xml"))
    root = next(x.get("full-path") for x in container.iter() if x.tag.endswith("rootfile"))
    package = ET.fromstring(book.read(root))
    items = [x.get("href") for x in package.iter() if x.tag.endswith("}item") and "html" in (x.get("media-type") or "")]
    return "\n".join(html_text(book.read(posixpath.join(posixpath.dirname(root), h)), links=False) for h in items)


def pdf_text(data: bytes) -> str:
    try:
        from pdfminer.high_level import extract_text
    except ImportError as e:
        raise RuntimeError("PDF needs the optional package pdfminer.six") from e
    return extract_text(io.BytesIO(data))


EXTRACTORS = {".pdf": pdf_text, ".md": markdown_text, ".epub": epub_text, ".docx": docx_text, ".html": html_text, ".htm": html_text}


def extract_text(path: str, data: bytes, markup: str = "strip") -> tuple[str, str | None]:
    """(text, error) by the path's suffix; other suffixes give an empty text."""
    m = re.search(r"[^/](\.[^./]+)$", path)
    kind = m[1].lower() if m else ""
    if kind not in EXTRACTORS:
        return "", None
    try:
        return (markdown_text(data, markup) if kind == ".md" else EXTRACTORS[kind](data)), None
    except Exception as e:  # noqa: BLE001  a file that can't be read is a row with an error
        return "", f"{type(e).__name__}: {e}"
