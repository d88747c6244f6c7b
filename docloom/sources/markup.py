"""HTML, Markdown and Word bodies as ordered blocks, in plain Python without third-party parsers.

HTML is read as a flat list of events in which every start knows the place of its end; implied ends are
put in while events arrive. Reading then is one scan with a stack, and an element's text is what stands
between its two places.
"""

from __future__ import annotations

import io
import re
import zipfile
from html.parser import HTMLParser
from xml.etree import ElementTree

#: Fixed sets of tags: never content, one block each, and inline (any other tag ends a run of text).
CHROME = frozenset("script style noscript template svg nav footer".split())
CONTROLS = frozenset("button select option".split())
HIDDEN_CLASSES = frozenset(("sr-only", "visually-hidden"))
BLOCKS = frozenset("p li blockquote td dd dt".split())
INLINE = frozenset(
    "a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
HEADINGS = frozenset(f"h{n}" for n in range(1, 7))
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Starts that end an open paragraph, and for each tag the open tags that its start ends, up to a scope.
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table ul dt dd".split()
)
ENDS = {
    "li": ({"li"}, {"ul", "ol"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
ZERO_WIDTH = "​‌‍﻿"


class _Events(HTMLParser):
    """events: [kind, tag or text, attributes, place of the end]."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.events: list[list] = []
        self.open: list[int] = []

    def _tag(self, n: int) -> str:
        return self.events[self.open[n]][1]

    def _close(self, depth: int) -> None:
        while len(self.open) > depth:
            at = self.open.pop()
            self.events[at][3] = len(self.events)
            self.events.append(["end", self.events[at][1], None, at])

    def _close_to(self, tags: set[str], scope: set[str]) -> None:
        for n in range(len(self.open) - 1, -1, -1):
            if self._tag(n) in tags:
                self._close(n)
                return
            if self._tag(n) in scope:
                return

    def handle_starttag(self, tag, attrs):
        if tag in ENDS_P:
            self._close_to({"p"}, {"button", "td", "th", "table", "li"} - {tag})
        if tag in HEADINGS and self.open and self._tag(len(self.open) - 1) in HEADINGS:
            self._close(len(self.open) - 1)
        if tag in ENDS:
            self._close_to(*ENDS[tag])
        self.events.append(["start", tag, {k: v or "" for k, v in reversed(attrs)}, -1])
        if tag in VOID:
            self.events[-1][3] = len(self.events)
            self.events.append(["end", tag, None, len(self.events) - 1])
        else:
            self.open.append(len(self.events) - 1)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        for n in range(len(self.open) - 1, -1, -1):
            if self._tag(n) == tag:
                self._close(n)
                return

    def handle_data(self, data):
        self.events.append(["text", data, None, -1])

    def handle_comment(self, data):
        self.events.append(["comment", data, None, -1])


def parsed(source: str) -> list[list]:
    reader = _Events()
    reader.feed(source)
    reader.close()
    reader._close(0)
    return reader.events


def _prose(text: str) -> str:
    text = text.strip()
    return "" if not text.strip(ZERO_WIDTH) else text


def _unseen(tag: str, attributes: dict, in_paragraph: bool) -> bool:
    if tag in CHROME:
        return True
    if tag == "button" and in_paragraph:
        return False
    return tag in CONTROLS or attributes.get("aria-hidden") == "true" or not HIDDEN_CLASSES.isdisjoint(attributes.get("class", "").split())


def _framed(text: str) -> str:
    lines = text.splitlines()
    filled = [k for k, line in enumerate(lines) if line.strip()]
    return "\n".join(lines[filled[0] : filled[-1] + 1]) if filled else ""


class Headings:
    """The ancestry of headings; skipped levels stay empty."""

    def __init__(self):
        self.path: list[str] = []

    def push(self, level: int, text: str) -> None:
        self.path = (self.path + [""] * level)[: level - 1] + [text]


def html_items(source: str) -> tuple[str, list[dict]]:
    """Title, and items with heading_path, fragment, text in document order."""
    events = parsed(source)
    starts = [k for k, e in enumerate(events) if e[0] == "start"]
    title = _only_text(events, next((k for k in starts if events[k][1] == "title"), None))
    body = next((k for k in starts if events[k][1] == "body"), None)
    begin, stop = (0, len(events)) if body is None else (body + 1, events[body][3])

    # what is left out, and what each <pre> that is not inside another holds
    dropped: set[int] = set()
    paragraphs = 0
    k = 0
    depth: list[bool] = []
    while k < len(events):
        kind, tag, attributes, end = events[k]
        if kind == "start":
            if _unseen(tag, attributes, paragraphs > 0):
                dropped.add(k)
                k = end + 1
                continue
            depth.append(tag == "p" or attributes.get("data-as") == "p")
            paragraphs += depth[-1]
        elif kind == "end":
            paragraphs -= depth.pop()
        k += 1

    def texts(at: int, with_code: bool) -> list[str]:
        out, n = [], at + 1
        while n < events[at][3]:
            kind, value, _, end = events[n]
            if kind == "start" and (n in dropped or (value == "pre" and not with_code)):
                n = end
            elif kind == "text":
                out.append(value)
            n += 1
        return out

    def prose(at: int) -> str:
        return " ".join(filter(None, map(_prose, texts(at, False))))

    def anchor(at: int) -> str | None:
        own = events[at][2].get("id", "").strip()
        if not own:
            inner = (events[n][2]["id"] for n in range(at + 1, events[at][3]) if events[n][0] == "start" and n not in dropped and "id" in events[n][2])
            own = next(inner, "").strip()
        return own or None

    headings, fragment, items = Headings(), None, []
    run: list[str] = []
    inside: list[tuple[bool, bool]] = []  # whether the text is read already, and whether the end ends a run
    read = False

    def emit(text: str) -> None:
        if text:
            items.append({"heading_path": list(headings.path), "fragment": fragment, "text": text})

    def flush() -> None:
        if run:
            emit(" ".join(run))
            run.clear()

    k = begin
    while k < stop:
        kind, value, attributes, end = events[k]
        if kind == "text":
            text = "" if read else _prose(value)
            if text:
                run.append(text)
        elif kind == "end":
            read, breaks = inside.pop()
            if breaks:
                flush()
        elif kind == "start":
            if k in dropped:
                k = end + 1
                continue
            if value == "pre":
                flush()
                emit(_framed("".join(texts(k, True))))
                k = end + 1
                continue
            before = read
            breaks = False
            if value in HEADINGS:
                flush()
                text = prose(k)
                if text:
                    headings.push(int(value[1]), text)
                    fragment = anchor(k)
                read = True
            elif value in BLOCKS or attributes.get("data-as") == "p":
                flush()
                if not read:
                    emit(prose(k))
                read = True
            elif value == "code" and not read and "\n" in "".join(texts(k, True)).strip():
                flush()
                emit(_framed("".join(texts(k, True))))
                k = end + 1
                continue
            elif value not in INLINE:
                flush()
                breaks = True
            inside.append((before, breaks))
        k += 1
    flush()
    return title, items


def _only_text(events: list[list], at: int | None) -> str:
    """The text of an element that holds one text and nothing else, at any depth."""
    while at is not None:
        children, n = [], at + 1
        while n < events[at][3]:
            children.append(n)
            n = events[n][3] + 1 if events[n][0] == "start" else n + 1
        if len(children) != 1:
            return ""
        if events[children[0]][0] != "start":
            return events[children[0]][1].strip()
        at = children[0]
    return ""


def _placed(items: list[dict]) -> list[dict]:
    """Offsets: code points of all items before, one between each."""
    at = 0
    for item in items:
        item["offset"] = at
        at += len(item["text"]) + 1
    return items


def html_blocks(source: str, stem: str = "") -> tuple[str, list[dict]]:
    title, items = html_items(source)
    return title or stem, _placed(items)


_ATX = re.compile(r"(#{1,6})\s+(.*?)\s*#*")
_FENCE = re.compile(r"\s*(?:```|~~~)")


def markdown_blocks(source: str, stem: str = "") -> tuple[str, list[dict]]:
    """Title (the first block's root heading, else the stem) and paragraphs under ATX headings."""
    headings, blocks, held = Headings(), [], []
    at = begin = 0
    fenced = False

    def close() -> None:
        body = "\n".join(held).strip()
        if body:
            blocks.append({"heading_path": list(headings.path), "fragment": None, "text": body, "offset": begin})
        held.clear()

    for line in source.replace("\r\n", "\n").replace("\r", "\n").splitlines(keepends=True):
        bare = line.rstrip("\n")
        if _FENCE.match(bare):
            fenced = not fenced
            held.append(bare)
        elif not fenced and (m := _ATX.fullmatch(bare)):
            close()
            headings.push(len(m[1]), m[2].strip())
        elif not bare.strip():
            close()
            begin = at + len(line)
        else:
            if not held:
                begin = at
            held.append(bare)
        at += len(line)
    close()
    return next((b["heading_path"][0] for b in blocks if b["heading_path"]), "") or stem, blocks


_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_STYLE = re.compile(r"heading\s*(\d+)", re.IGNORECASE)
#: Run contents that stand for a character.
_CHARACTERS = {"tab": "\t", "ptab": "\t", "cr": "\n", "noBreakHyphen": "-"}


def _run_text(run) -> str:
    out = []
    for c in run:
        name = c.tag.removeprefix(_WORD)
        if name == "t":
            out.append(c.text or "")
        elif name == "br":
            out.append("\n" if c.get(f"{_WORD}type", "textWrapping") == "textWrapping" else "")
        else:
            out.append(_CHARACTERS.get(name, ""))
    return "".join(out)


def docx_blocks(content: bytes, stem: str = "") -> tuple[str, list[dict]]:
    """Title and body paragraphs of a Word file; heading styles make the path, the first Title style the title."""
    with zipfile.ZipFile(io.BytesIO(content)) as package:
        names = set(package.namelist())
        body = ElementTree.fromstring(package.read("word/document.xml")).find(f"{_WORD}body")
        styles, core = {}, ""
        if "word/styles.xml" in names:
            for s in ElementTree.fromstring(package.read("word/styles.xml")).iter(f"{_WORD}style"):
                name = s.find(f"{_WORD}name")
                styles[s.get(f"{_WORD}styleId")] = name.get(f"{_WORD}val", "") if name is not None else ""
        if "docProps/core.xml" in names:
            found = ElementTree.fromstring(package.read("docProps/core.xml")).find("{http://purl.org/dc/elements/1.1/}title")
            core = (found.text or "").strip() if found is not None else ""
    headings, blocks, title, at = Headings(), [], "", 0
    for p in body.findall(f"{_WORD}p") if body is not None else []:
        runs = [r for c in p for r in ([c] if c.tag == f"{_WORD}r" else c.findall(f"{_WORD}r") if c.tag == f"{_WORD}hyperlink" else [])]
        text = "".join(map(_run_text, runs)).strip()
        mark = p.find(f"{_WORD}pPr/{_WORD}pStyle")
        style_id = mark.get(f"{_WORD}val", "") if mark is not None else ""
        style = styles.get(style_id) or style_id
        if not text:
            continue
        if style.lower() == "title" and not title:
            title = text
        elif m := _STYLE.fullmatch(style):
            headings.push(int(m[1]), text)
        else:
            blocks.append({"heading_path": list(headings.path), "fragment": None, "text": text, "offset": at})
            at += len(text) + 1
    return title or core or stem, blocks


def plain_blocks(source: str, stem: str = "") -> tuple[str, list[dict]]:
    blocks, at = [], 0
    for piece in source.replace("\r\n", "\n").replace("\r", "\n").split("\n\n"):
        if piece.strip():
            blocks.append({"heading_path": [], "fragment": None, "text": piece.strip(), "offset": at})
        at += len(piece) + 2
    return stem, blocks


#: What reads each suffix; text is UTF-8 with bad bytes replaced.
READERS = {
    ".md": markdown_blocks, ".markdown": markdown_blocks, ".html": html_blocks, ".htm": html_blocks,
    ".txt": plain_blocks, ".text": plain_blocks, ".docx": docx_blocks,
}


def read_file(path: str, content: bytes) -> tuple[str, list[dict]]:
    """Title and blocks of a file by its suffix; another suffix is an error that lists those known."""
    name = path.rsplit("/", 1)[-1]
    stem, dot, suffix = name.rpartition(".")
    reader = READERS.get(f".{suffix.lower()}") if dot else None
    if reader is None:
        raise ValueError(f"unsupported format {dot + suffix!r}; supported: {', '.join(sorted(READERS))}")
    return reader(content, stem) if reader is docx_blocks else reader(content.decode("utf-8", "replace"), stem)
