"""A slow, plain chunker used to check the expression-based one on fixtures."""

from __future__ import annotations

import re


def tokens(text: str) -> int:
    return len(text.split()) * 4 // 3


def clean_path(path: str) -> str:
    names = [p.strip().lstrip("#").strip() for p in path.split(">")]
    return " > ".join(n for n in names if n)


def prefix_of(path: str) -> str:
    name = clean_path(path)
    return f"## {name}\n\n" if name else ""


def blocks(markdown: str) -> list[tuple[str, str, str]]:
    found, stack, held, fenced = [], [], "", False

    def close(kind: str) -> None:
        nonlocal held
        if kind == "Code" or held.strip():
            found.append((" > ".join(stack), kind, held))
        held = ""

    for line in re.findall(r"[^\n]*\n|[^\n]+", markdown):
        fence = line.lstrip().startswith(("```", "~~~"))
        title = re.match(r"\s*(#{1,6}) (.*\S)", line)
        if fenced:
            held += line
            if fence:
                close("Code")
                fenced = False
        elif title:
            close("Info")
            level = len(title.group(1))
            stack = (stack + [""] * 6)[: level - 1] + [title.group(2).strip()]
        elif fence:
            close("Info")
            held, fenced = line, True
        else:
            held += line
    close("Code" if fenced else "Info")
    return found


def by_words(text: str, limit: int) -> list[str]:
    out, held = [], []
    for word in text.split():
        if held and tokens(" ".join(held)) + 1 > limit:
            out.append(" ".join(held))
            held = []
        held.append(word)
    return out + ([" ".join(held)] if held else [])


def by_sentences(text: str, limit: int) -> list[str]:
    out, held = [], ""
    for sentence in re.findall(r"[^.!?]*[.!?][ \t\n]*|[^.!?]+", text):
        if not sentence.strip():
            continue
        if tokens(sentence) > limit:
            out += ([held] if held else []) + by_words(sentence, limit)
            held = ""
        elif held and tokens(held) + tokens(sentence) > limit:
            out.append(held)
            held = sentence
        else:
            held += sentence
    return out + ([held] if held else [])


def prose(body: str, target: int, limit: int) -> list[str]:
    out, held = [], ""
    for paragraph in (p.strip() for p in body.split("\n\n")):
        if not paragraph:
            continue
        if tokens(paragraph) > limit:
            out += ([held] if held else []) + by_sentences(paragraph, limit)
            held = ""
        elif held and tokens(held) + tokens(paragraph) <= target:
            held += "\n\n" + paragraph
        else:
            out += [held] if held else []
            held = paragraph
    return out + ([held] if held else [])


def by_characters(line: str, budget: int) -> list[str]:
    out, held = [], ""
    for char in line:
        held += char
        if tokens(held) >= budget:
            out.append(held)
            held = ""
    return out + ([held] if held else [])


def glue(items: list[str], budget: int, cut: bool) -> list[str]:
    out, held = [], ""
    for item in items:
        if cut and tokens(item) > budget:
            out += ([held] if held else []) + by_characters(item, budget)
            held = ""
        elif held and tokens(held + "\n" + item) > budget:
            out.append(held)
            held = item
        else:
            held = held + "\n" + item if held else item
    return out + ([held] if held else [])


def code(body: str, path: str, limit: int) -> list[tuple[str, str]]:
    whole = prefix_of(path) + body
    if tokens(whole) <= limit:
        return [(path, whole)]
    lines = body.splitlines()
    opener = lines[0]
    bare = opener.lstrip()
    closer = bare[: len(bare) - len(bare.lstrip(bare[0]))]
    ends = len(lines) > 1 and lines[-1].lstrip().startswith(("```", "~~~"))
    inner = lines[1:-1] if ends else lines[1:]
    room = max(1, limit - tokens(prefix_of(path)) - tokens(opener) - tokens(closer) - 8)
    parts: list[list[str]] = [[]]
    for line in inner:
        if re.match(r"\s*(fn |def |function |class )", line) and parts[-1]:
            parts.append([])
        parts[-1].append(line)
    pieces: list[str] = []
    for part in parts:
        text = "\n".join(part)
        pieces += [text] if tokens(text) <= room else glue(part, room, True)
    out = []
    for number, group in enumerate(glue(pieces, room, False), 1):
        name = f"{path} (part {number})"
        out.append((name, f"{prefix_of(name)}{opener}\n{group}\n{closer}\n"))
    return out


def chunk(markdown: str, limit: int = 512, target: int = 384) -> list[tuple[str, str, str]]:
    out = []
    for path, kind, body in blocks(markdown):
        if kind == "Code":
            out += [(clean_path(p), kind, text) for p, text in code(body, path, limit)]
        else:
            lead = prefix_of(path)
            room = max(1, limit - tokens(lead))
            goal = min(max(0, target - tokens(lead)), room)
            out += [(clean_path(path), kind, lead + piece) for piece in prose(body, goal, room)]
    return out
