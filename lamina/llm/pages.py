"""What a page says, headers aside, and the figures by which spam is told."""

from __future__ import annotations

import math
import re
from collections import Counter

from lamina.llm.suffix import coverage

#: Lines that carry layout, not text. Fixed by the formats in which commits are written down.
_HEADER = re.compile(
    r"commit [0-9a-f]{7,64}$|(?:Author|Date|From|To|Commit|AuthorDate|CommitDate|Merge|Index|Property changes on|Modified|Added|Deleted|Name|User|Node|Parent): ?|From [0-9a-f]{7,64}"
    r"|# (?:HG|User|Date|Node|Parent|Branch)\b|r\d+ \||={20,}|-{20,}|---$|-- ?$|```|_.* committed .*_$|(?:diff|index|new file mode|deleted file mode|similarity index|rename|Binary files) |\\ No newline"
)
_SUBJECT = re.compile(r"Subject: (?:\[[^\]]*\] ?)?")
_DIFF = re.compile(r"diff --git |diff -r |Index: |Binary files |--- |\+\+\+ ")
_HUNK = re.compile(r"@@ ")
_TRAILER = re.compile(r"\s*[A-Z][A-Za-z-]+-(?:by|[Ii]d|to): |\s*Refs?: ")


def segments(text: str) -> tuple[list[str], list[str]]:
    """Lines of the message and lines added, without layout; removed and unchanged lines are left out."""
    message: list[str] = []
    added: list[str] = []
    in_diff = in_hunk = False
    for line in text.splitlines():
        if in_diff:
            if line[:1] == "+" and (in_hunk or line[:4] != "+++ "):
                added.append(line[1:])
            elif line[:2] == "@@":
                in_hunk = True
            elif line[:10] == "diff --git" or line[:7] == "Index: ":
                in_hunk = False
            elif line[:1] not in ("-", "+", " ", "") and not in_hunk and not _HEADER.match(line):
                message.append(line)
            continue
        if _DIFF.match(line):
            in_diff = True
        elif _HUNK.match(line):
            in_diff = in_hunk = True
        elif (subject := _SUBJECT.match(line)) is not None:
            message.append(line[subject.end() :])
        elif line.strip() and not _HEADER.match(line) and not _TRAILER.match(line):
            message.append(line)
    return message, added


def bulk(text: str) -> list[str]:
    """The larger of the message and the added lines; the message if they are equal."""
    message, added = segments(text)
    return added if sum(map(len, added)) > sum(map(len, message)) else message


_LINK = r"(?:https?:)?//[^\s\"'<>\])|]+|www\.[^\s\"'<>\])|]+|(?:[\w-]+\.)+[a-z]{2,}/[^\s\"'<>\])|]*"
_DOTTED = r"(?:[\w-]+\.)+[^\W\d_]{2,}"
#: Scripts written without spaces, or with endings that do what words do elsewhere: each character is a word.
_SINGLE = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uac00-\ud7af"
_TOKEN = re.compile(rf"{_LINK}|\w(?:\.\w){{3,}}|{_DOTTED}|[{_SINGLE}]|[^\W\d_{_SINGLE}]+(?:['’-][^\W\d_{_SINGLE}]+)*|\d[\d.,]*|[^\s\w]|_|\w")
_IS_LINK, _IS_DOTTED = re.compile(_LINK), re.compile(_DOTTED)
_ORDINAL = re.compile(r"\d+[.)] ")
_CAPITAL = re.compile(r"\b[A-ZÀ-ÖØ-Þ]")
_CODE = frozenset("{}()[];=<>*&^%$#@!\\|~`+\"'/_")
_MONEY = frozenset("€$£¥₽")
_SEPARATORS = frozenset("|,;/")
#: Words that a line must have before it can be a clause.
CLAUSE_LINE = 4

FEATURES = (
    "log_chars", "lines", "cover_1", "cover_3", "cover_6", "link_share", "links_per_line", "clause_share", "clause_lines", "ended_lines", "money",
    "code_share", "distinct", "top_word", "top_five", "words_per_line", "single_lines", "digits", "spaced_out", "upper", "list_marks", "word_share", "long_words", "longest_repeat", "hyphened", "separators",
    "no_clause_cover", "at_marks", "hash_marks", "numbered", "quotes", "bulk_share", "dotted",
)


#: Kinds of tokens.
_OTHER, _WORD, _NUMBER, _URL, _SPACED, _NAME = range(6)


class _Kinds(dict):
    """Kind of each (lower-case) token; bounded."""

    def __missing__(self, token: str) -> int:
        if len(self) > 1 << 17:
            self.clear()
        if _IS_LINK.fullmatch(token):
            kind = _URL
        elif token[0].isdecimal():
            kind = _NUMBER
        elif len(token) > 4 and token[1] == "." and "." in token[3:4]:
            kind = _SPACED
        elif "." in token and _IS_DOTTED.fullmatch(token):
            kind = _NAME
        elif token[0].isalnum():
            kind = _WORD
        else:
            kind = _OTHER
        self[token] = kind
        return kind


_KINDS = _Kinds()


def _lines(text: str | None) -> tuple[list[str], int, int]:
    """The bulk's lines that aren't blank, and the characters of message and added lines."""
    message, added = segments(text) if text else ((), ())
    size, other = sum(map(len, added)), sum(map(len, message))
    return [body for line in (added if size > other else message) if (body := line.strip())], size, other


def clause_candidates(text: str | None) -> set[str]:
    """Words of a page that stand in lines long enough to be clauses."""
    out: set[str] = set()
    kind = _KINDS.__getitem__
    for body in _lines(text)[0]:
        words = [t for t in _TOKEN.findall(body.lower()) if kind(t) == _WORD]
        if len(words) >= CLAUSE_LINE:
            out.update(words)
    return out


def figures(text: str | None, ties: frozenset[str] = frozenset()) -> list[float] | None:
    """The figures of a page; None for a null text or one without message and added lines.

    ``ties`` are the words that tie clauses together, learned from labelled pages.
    """
    tokens: list[str] = []
    clause = clause_lines = ended = single = marks = kept = words = capitals = 0
    kind = _KINDS.__getitem__
    numbered = 0
    lines, size, other = _lines(text)
    for body in lines:
        kept += 1
        if body[0] in "-*•" or body[:4] == "<li>":
            marks += 1
        elif body[0].isdecimal() and _ORDINAL.match(body):
            numbered += 1
        here = _TOKEN.findall(body.lower())
        tokens += here
        spoken = bytes(map(kind, here)).count(_WORD)
        said = sum(map(ties.__contains__, here))
        capitals += len(_CAPITAL.findall(body))
        words += spoken
        clause += said
        if said and spoken >= CLAUSE_LINE:
            clause_lines += 1
        if body[-1] in ".!?。:;":
            ended += 1
        if spoken <= 1:
            single += 1
    total = len(tokens)
    if not total:
        return None
    counts = Counter(tokens)
    link_chars = links = word_chars = code = money = digits = spaced = hyphened = separators = long_words = distinct = 0
    dotted = 0
    tops = []
    for token, n in counts.items():
        k = kind(token)
        if k == _WORD:
            distinct += 1
            tops.append(n)
            word_chars += n * len(token)
            if "-" in token:
                hyphened += n
            if len(token) > 14:
                long_words += n
        elif k == _OTHER:
            if token in _CODE:
                code += n
            if token in _MONEY:
                money += n
            if token in _SEPARATORS:
                separators += n
        elif k == _NUMBER:
            digits += n * len(token)
        elif k == _URL:
            links += n
            link_chars += n * len(token)
        elif k == _NAME:
            dotted += n
        else:
            spaced += n
    sizes = list(map(len, tokens))
    chars = sum(sizes)
    longest, cover = coverage(tokens, sizes, (1, 3, 6))
    cover = [c / chars for c in cover]
    tops.sort(reverse=True)
    clause_share, many = clause / max(1, words), max(1, words)
    return [
        math.log1p(chars), math.log1p(kept), *cover, link_chars / chars, links / kept, clause_share, clause_lines / kept, ended / kept, money / total,
        code / total, distinct / many, tops[0] / words if words else 0.0, sum(tops[:5]) / words if words else 0.0, words / kept, single / kept, digits / chars, spaced / total,
        capitals / many, marks / kept, word_chars / chars, long_words / many, math.log1p(longest), hyphened / many, separators / total,
        (1 - min(1.0, clause_share * 5)) * cover[0], counts["@"] / kept, counts["#"] / kept, numbered / kept, (counts['"'] + counts["'"]) / total, max(size, other) / max(1, size + other), dotted / total,
    ]
