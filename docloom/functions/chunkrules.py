"""The sequential chunk rules of one document, in plain Python.

A block is a mapping with section, heading_path (list), text, page, page_end, printed_page, url, fragment,
image_count, figure_only, subdivision. Rules, in order: consecutive blocks of one section and path are a unit;
a small unit takes in those after it while section and parent path agree, and moves to its parent path each
time; a numbered stub goes in front of its own first subsection; a unit over the cap is divided at its marked
subheadings, then at blocks, then inside blocks. Budgets add atoms and convert once.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from itertools import groupby

#: Fixed values.
MAX_TOKENS, MIN_TOKENS, STUB_TOKENS = 1200, 100, 30
SUBWORD = 1.3
_WIDE = re.compile("[\\u3000-\\u30ff\\u3400-\\u4dbf\\u4e00-\\u9fff\\uac00-\\ud7af\\uf900-\\ufaff]")
_ATOM = re.compile(r"\w+|[^\w\s]")


def atoms(text: str) -> int:
    wide = len(_WIDE.findall(text))
    return len(_ATOM.findall(_WIDE.sub(" ", text) if wide else text)) + round(wide / SUBWORD)


def tokens(count: int) -> int:
    return int(count * SUBWORD)


@dataclass(frozen=True)
class Unit:
    section: str | None
    path: tuple[str, ...]
    blocks: tuple[dict, ...] = field(default=())

    @property
    def text(self) -> str:
        return _joined(self.blocks).strip()

    @property
    def size(self) -> int:
        return tokens(atoms(self.text))

    def taking(self, other: Unit, **changes) -> Unit:
        return replace(self, blocks=self.blocks + other.blocks, **changes)


def _joined(blocks) -> str:
    return "\n\n".join(b["text"] for b in blocks)


def _units(blocks: list[dict]) -> list[Unit]:
    agree = lambda b: (b["section"], tuple(b["heading_path"]))
    return [Unit(section, path, tuple(run)) for (section, path), run in groupby(blocks, agree)]


def _merged(units: list[Unit]) -> list[Unit]:
    out: list[Unit] = []
    growing = False
    for unit in units:
        last = out[-1] if growing else None
        if last and last.size < MIN_TOKENS and unit.section == last.section and unit.path[:-1] == last.path[:-1]:
            out[-1] = last.taking(unit, path=last.path[:-1] or last.path)
        else:
            out.append(unit)
            growing = True
    return out


def _stubs_folded(units: list[Unit]) -> list[Unit]:
    out: list[Unit] = []
    held: Unit | None = None
    for unit in units:
        if held is not None:
            under = unit.section is not None and unit.section.startswith(f"{held.section}.")
            if under and held.size < STUB_TOKENS:
                unit = replace(unit, blocks=held.blocks + unit.blocks)
            else:
                out.append(held)
            held = None
        if unit.section is None:
            out.append(unit)
        else:
            held = unit
    return out + [held] if held is not None else out


def packed(items: list, size) -> list[list]:
    """Greedy groups: an item that would take a group over the cap begins the next."""
    groups: list[list] = []
    total = 0
    for item in items:
        n = size(item)
        if groups and tokens(total + n) <= MAX_TOKENS:
            groups[-1].append(item)
            total += n
        else:
            groups.append([item])
            total = n
    return groups


def _block_pieces(block: dict) -> list[dict]:
    if tokens(atoms(block["text"])) <= MAX_TOKENS:
        return [block]
    pieces = block["text"].split("\n\n")
    if len(pieces) == 1:
        pieces = block["text"].splitlines()
    return [{**block, "text": "\n".join(group)} for group in packed(pieces, atoms)]


def _divided(unit: Unit) -> list[tuple[tuple[str, ...], list[dict]]]:
    """Paths and blocks of the parts of a unit over the cap."""
    runs: list[tuple[str, list[dict]]] = []
    for b in unit.blocks:
        if b["subdivision"] and not b["figure_only"]:
            lines = b["text"].splitlines()
            runs.append((lines[0].strip() if lines else "", [b]))
        elif runs:
            runs[-1][1].append(b)
        else:
            runs.append(("", [b]))
    parts = [(unit.path, list(unit.blocks))]
    if len(runs) > 1:
        parts = []
        for group in packed(runs, lambda r: sum(atoms(b["text"]) for b in r[1])):
            labels = [label for label, _ in group if label]
            path = unit.path + (labels[0],) if len(labels) == 1 else unit.path
            parts.append((path, [b for _, blocks in group for b in blocks]))
    out = []
    for path, blocks in parts:
        if tokens(atoms(_joined(blocks))) <= MAX_TOKENS:
            out.append((path, blocks))
        else:
            pieces = [piece for b in blocks for piece in _block_pieces(b)]
            out += [(path, group) for group in packed(pieces, lambda b: atoms(b["text"]))]
    return [(path, blocks) for path, blocks in out if any(b["text"].strip() for b in blocks)]


def _number(value):
    return None if value is None or value != value else int(value)


def chunk_rows(blocks: list[dict]) -> list[dict]:
    """The chunks of a document's blocks, in order, without kinds."""
    clean = []
    for b in blocks:
        clean.append(
            {
                **{k: None if b.get(k) is None or b.get(k) != b.get(k) else b[k] for k in ("section", "url", "fragment")},
                **{k: _number(b.get(k)) for k in ("page", "page_end", "printed_page")},
                "heading_path": [] if b.get("heading_path") is None else list(b["heading_path"]),
                "text": b.get("text") or "",
                "image_count": _number(b.get("image_count")) or 0,
                "figure_only": bool(b.get("figure_only")),
                "subdivision": bool(b.get("subdivision")),
            }
        )
    out = []
    for unit in _stubs_folded(_merged(_units(clean))):
        text = unit.text
        if not text:
            continue
        for path, parts in [(unit.path, list(unit.blocks))] if tokens(atoms(text)) <= MAX_TOKENS else _divided(unit):
            paged = [b for b in parts if b["page"] is not None]
            printed = [b["printed_page"] for b in parts if b["printed_page"] is not None]
            out.append(
                {
                    "ordinal": len(out),
                    "heading_path": " > ".join(p for p in path if p),
                    "text": _joined(parts).strip(),
                    "section": unit.section,
                    "page_start": min((b["page"] for b in paged), default=None),
                    "page_end": max((b["page"] if b["page_end"] is None else b["page_end"] for b in paged), default=None),
                    "printed_page_start": min(printed, default=None),
                    "url": parts[0]["url"],
                    "fragment": parts[0]["fragment"],
                    "image_count": sum(b["image_count"] for b in parts),
                }
            )
    return out
