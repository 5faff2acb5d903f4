"""Reading of works and of typed references into the attributes they share."""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Container

import regex

from corpusloom.llm.names import PARTICLES
from corpusloom.llm.text import fold, plain

#: Notices put before titles, and words that stand for further authors.
NOTICES = ("retracted article", "retraction note", "retracted", "retraction", "withdrawn", "erratum to", "erratum", "corrigendum to", "corrigendum", "correction to", "correction", "reprint of")
OTHERS = frozenset(("et", "al", "others", "and", "und", "y", "e", "in", "eds", "ed", "dir", "coll"))

_notices = tuple(n + " " for n in NOTICES)
_doi = regex.compile(r"(?:https?://(?:dx\.)?doi\.org/|\bdoi\s*[:.]?\s*)?\b10\.\s?\d{4,6}\s?/\s?[^\s;]+(?:\s?[._]\s?[^\s;]+|\s[\w.]*\d[\w.]*)*\s*$", regex.I)
_doi_any = regex.compile(r"(?:https?://(?:dx\.)?doi\.org/|\bdoi\s*[:.]?\s*)?\b10\.\d{4,6}/\S+", regex.I)
_broken = regex.compile(r"(\p{Ll})- (\p{Ll})")
_tag = regex.compile(r"<[^<>]{1,60}>|&\w+;")
_lead = regex.compile(r"^\s*(?:\p{Lu}{3,}(?:\s\p{Lu}{3,})*\s*>\s*)?(?:[\[(]\d+[\])]\s*|\d{1,3}\.\s+)?")
_int = regex.compile(r"(?<![\p{L}\d])(?<!\p{L}-)\d+")
_year = regex.compile(r"(?<!\d)(?:19|20)\d\d(?!\d)")
_dated = regex.compile(r"[(\[]\s*(?:(?:19|20)?[\d\s-]{2,6}|n\.\s?d\.?|s\.\s?d\.?|in press|)\s*[)\]]\s*[.:,]?\s+")
_tail = regex.compile(
    r"[,.\s]*(?:"
    r"\b\d+\s?\(\d*\),\s*\d*\s*[-–]?\s*\d*"  # 12(5), 1993-2017
    r"|\b\d*\s*:\s*\d+"  # 119:1444
    r"|\b(?:\d{4})?\s*;\s*\d*\s*:?\s*\d*"  # 2023;30:840
    r"|,?\s*(?:\d{4})?\s*,\s*(?:(?:t|vol|v)\.\s*)?\d*\s*,?\s*pp?\.\s*\d+\s*[-–]?\s*\d*"  # , 2019, t. 54, p. 1517-1541
    r"|\b\d*\s*[(\[](?:\d{4}|n\.d\.|in press|)[)\]]\s*\d*\s*[-–]?\s*\d*"  # 91 (2023) 1647–1651
    r"|\b\d+,\s*\d+\s*[(\[](?:\d{4}|n\.d\.|in press|)[)\]]"  # 158, 1952 (1977)
    r"|,\s*(?:\d{4}|n\.d\.)"  # , 1997
    r")[\s.,]*$"
)
#: The signs that a tail can hold; it begins behind the last other one.
_IN_TAIL = "0123456789()[],-–:;. \t\n" + "tvolpndires"
_abbreviated = regex.compile(r"(?:^|[.,…:?!]\s+)((?:\p{Lu}\p{Ll}{1,9}\.?\s)?(?:\p{Lu}\p{Ll}{1,9}\.\s?){1,3}\p{Lu}\p{Ll}{1,9}\.?)\s*$")
_person = regex.compile(r"^(?:\p{Lu}\.[\s-]*)+(?:\p{Ll}+\s)*[\p{L}'’-]+(?:\s\p{Lu}[\p{L}'’-]+)?$")
_name_word = regex.compile(r"\p{L}[\p{L}\p{M}'’-]*\.?|,")
_ascii_word = re.compile(r"[A-Za-z][A-Za-z'-]*\.?|,")
_dash = regex.compile(r"\s[-–—]\s")
_and = regex.compile(r"\s(?:and|und|et|y|&)\s")
_et_al = regex.compile(r"\s+(?:et al\.?|& al\.?|and others|et)\s*$")
_al_end = regex.compile(r"\b(?:al\.?|others)\s*$")
_spaces = regex.compile(r"\s+")
_list_marks = regex.compile(r"[,;&/]")
_between = regex.compile(r"[,;&/]|\s(?:and|und|et|y)\s")


SKIPPED, KEPT, FIRST_ONLY = 0, 1, 2


@functools.lru_cache(200_000)
def _bare(w: str) -> tuple[str, int, str]:
    """(letters, whether it may be a surname, folded word) of a word; one of few capitals may be one only in front."""
    if w.isascii() and w.isalpha():
        f = bare = w.lower()
    else:
        f = plain(w.replace("'", "").replace("’", "").rstrip("."))
        bare = f.replace(" ", "")
    if len(bare) < 3 or f in OTHERS or f in PARTICLES or (w[-1] == "." and len(bare) < 5):
        return bare, SKIPPED, f
    return bare, FIRST_ONLY if len(bare) < 4 and w.isupper() else KEPT, f


def surname_keys(text: str, given: Container[str]) -> list[str]:
    """Keys of the surnames in a list of authors, in order, each once."""
    if text.isalpha():  # one word
        bare, kind, f = _bare(text)
        return [] if len(text) < 3 or kind == SKIPPED or f in given else [bare]
    out: dict[str, None] = {}
    kept: list[str] = []
    several = False
    for w in (_ascii_word if text.isascii() else _name_word).findall(_between.sub(",", text)):
        if w == ",":
            if kept:
                out["".join(kept)] = None
                if len(kept) > 1:  # the first word may be a misspelt given name
                    out[kept[-1]] = None
                kept = []
            several = False
            continue
        first, several = not several, True
        if len(w) < 3:
            continue
        bare, kind, f = _bare(w)
        if kind == SKIPPED or (kind == FIRST_ONLY and not first):
            continue
        if f in given or (" " in f and all(p in given for p in f.split())):
            continue
        kept.append(bare)
    if kept:
        out["".join(kept)] = None
        if len(kept) > 1:
            out[kept[-1]] = None
    return list(out)


def title_words(title: str | None) -> str:
    """Folded words of a title without markup and notices."""
    if not title:
        return ""
    t = plain(_tag.sub(" ", title) if "<" in title or "&" in title else title)
    if t.startswith(_notices):
        for n in _notices:
            if t.startswith(n):
                t = t[len(n) :]
    return t


def split_reference(raw: str) -> tuple[str, str, str]:
    """(authors, title, journal) of a reference without label, identifier and figures; parts that are not there are empty."""
    body, journal = raw, ""
    m = _tail.search(body, max(0, len(body) - 70, len(body.rstrip(_IN_TAIL))))
    if m:
        body = body[: m.start()].rstrip(" ,.") + ("." if body[: m.start()].rstrip().endswith(".") else "")
    if " / " in body:
        title, _, rest = body.partition(" / ")
        authors, dot, journal = rest.rpartition(". ")
        if not dot:
            authors = rest
        return authors, title, journal
    m = _dated.search(body, 2)
    authors = ""
    head = body[:2] + body[2 : m.start()].rstrip() if m else ""
    if m and len(head) < 250 and m.end() < len(body) and head[-1:] != ":":
        authors, body = head, body[m.end() :]
    elif m := _dash.search(body):
        head = body[: m.start()]
        if head.isupper() or sum(map(str.isupper, head)) > 0.5 * sum(map(str.isalpha, head)):
            authors, body = head, body[m.end() :]
    if m := _abbreviated.search(body, max(0, len(body) - 70)):
        journal, body = m.group(1), body[: m.start(1)]
    if not authors:
        parts = body.split(", ")
        k = 0
        while k < len(parts):
            names = [p.strip() for p in _and.split(parts[k]) if p.strip()]
            bare = [_et_al.sub("", p).rstrip() for p in names]
            if not all(_person.match(p) or p in ("others", "al", "al.") for p in bare):
                break
            k += 1
            if len(bare) > 1 or _al_end.search(parts[k - 1]):
                break
        authors, body = ", ".join(parts[:k]), ", ".join(parts[k:])
    body = body.strip(" ,")
    if not journal:
        head, dot, last = body.rpartition(". ")
        if dot and len(head) > 12:
            body, journal = head, last
    return authors, body, journal


def read_reference(raw: str | None, author: str | None, given: Container[str]) -> tuple[list[str], str, str, list[int], list[int], str]:
    """(surnames, title words, journal stems, years, other numbers, identifier) of a typed reference."""
    names: list[str] = []
    title = journal = doi = ""
    years: list[int] = []
    numbers: list[int] = []
    if raw and raw.strip():
        text = " ".join((raw if raw.isascii() else unicodedata.normalize("NFC", raw)).split())
        if "- " in text:
            text = _broken.sub(r"\1\2", text)
        if "10." in text and ((m := _doi.search(text)) or (m := _doi_any.search(text))):
            found = m.group()
            doi = _spaces.sub("", found[found.find("10.") :]).lower().rstrip(".,;")
            text = (text[: m.start()] + " " + text[m.end() :]).strip(" .,;")
        text = _tag.sub(" ", text) if "<" in text or "&" in text else text
        text = text[_lead.match(text).end() :]
        years = [int(y) for y in _year.findall(text)]
        numbers = [int(x) for x in _int.findall(text) if len(x) < 6]
        authors, title, journal = split_reference(text)
        names = surname_keys(authors, given)
    if author:
        names = list(dict.fromkeys([*names, *surname_keys(author, given)]))
    stems = " ".join([w[:3] for w in plain(journal).split() if len(w) > 2 and not w.isdigit()])
    return names, title_words(title), stems, list(dict.fromkeys(years)), list(dict.fromkeys(numbers)), doi


def read_work(families: list[str | None], title: str | None, issued: str | None, source: str | None, volume: str | None, page: str | None, doi: str | None) -> tuple[list[str], str, str, list[int], list[int], str]:
    """The same of a work of the register; its numbers are volume and first page, -1 where missing."""
    names = list(dict.fromkeys(k for f in families if f for k in surname_keys(f if f.isalpha() else _list_marks.sub(" ", f), frozenset())))
    number = lambda x: int(x) if x and (x := x.strip()).isdecimal() and len(x) < 7 else -1
    year = _year.search(issued or "")
    stems = " ".join([w[:3] for w in plain(source).split() if len(w) > 2])
    return names, title_words(title), stems, [int(year.group())] if year else [], [number(volume), number(page)], fold(doi or "").strip()
