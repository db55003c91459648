"""Pages: readable text, titles and form controls of HTML, by the standard library's parser."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
# Elements whose text isn't the page's own; limits of what is read of a control.
BOILERPLATE = frozenset("script style noscript template svg nav header footer aside form iframe".split())
MAX_FIELDS, MAX_LABEL, MAX_HELP, MAX_OPTIONS, MAX_VALUE, LABEL_DEPTH = 400, 200, 180, 40, 2000, 4
SECTION_TAGS = frozenset("h1 h2 h3 h4 h5 h6 legend header".split())
SECRET_TYPES = frozenset(("password", "file"))
TITLE = r"(?is)<title[^>]*>(.*?)</title>"

FIELD_SCHEMA = (
    "page_id bigint, idx int, field_id string, tag string, type string, name string, id string, label string, placeholder string, "
    "aria_label string, required boolean, max_length int, options array<string>, help_text string, current_value string, "
    "readonly boolean, disabled boolean, section_context string, selector string"
)


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []

    def walk(self) -> Iterator[Node]:
        stack = [x for x in reversed(self.children) if isinstance(x, Node)]
        while stack:
            n = stack.pop()
            yield n
            stack += [x for x in reversed(n.children) if isinstance(x, Node)]

    def strings(self, skip: frozenset[str] = frozenset()) -> Iterator[str]:
        stack: list[Node | str] = list(reversed(self.children))
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                yield x
            elif x.tag not in skip:
                stack += reversed(x.children)

    def text(self, skip: frozenset[str] = frozenset()) -> str:
        return " ".join(" ".join(self.strings(skip)).split())

    def before(self) -> Iterator[Node]:
        """Element siblings before this one, nearest first."""
        if self.parent:
            kin = [x for x in self.parent.children if isinstance(x, Node)]
            yield from reversed(kin[: kin.index(self)])

    def up(self) -> Iterator[Node]:
        node = self.parent
        while node is not None:
            yield node
            node = node.parent


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        if tag == "option" and self.at.tag == "option":
            self.at = self.at.parent
        node = Node(tag, {k: v or "" for k, v in reversed(attrs)}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_endtag(self, tag):
        node = self.at
        while node is not self.root and node.tag != tag:
            node = node.parent
        if node is not self.root:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse(html: str | None) -> Node:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root


def readable_text(html: str | None) -> str:
    """Text of main, else article, else the element of role main, else the longest block, without boilerplate; a line per string."""
    root = parse(html)
    nodes = [n for n in root.walk() if n.tag not in BOILERPLATE and not any(p.tag in BOILERPLATE for p in n.up())]
    pick = next((n for n in nodes if n.tag == "main"), None) or next((n for n in nodes if n.tag == "article"), None)
    pick = pick or next((n for n in nodes if n.attrs.get("role") == "main"), None)
    if pick is None:
        body = next((n for n in nodes if n.tag == "body"), root)
        blocks = [n for n in body.walk() if n.tag in ("div", "section") and n in nodes]
        pick = max(blocks or [body], key=lambda n: len(n.text(BOILERPLATE)))
    return "\n".join(x.strip() for x in pick.strings(BOILERPLATE) if x.strip())


def title(html: Column) -> Column:
    """The title element without tags, else a title in linked data; empty if there is none."""
    own = F.trim(F.regexp_replace(F.regexp_extract(html, TITLE, 1), "(?s)<[^>]+>", " "))
    linked = F.trim(F.regexp_extract(html, r'(?is)<script[^>]+application/ld\+json[^>]*>.*?"title"\s*:\s*"([^"]{3,200})"', 1))
    return F.coalesce(F.nullif(own, F.lit("")), linked, F.lit(""))


def plain_text(html: Column) -> Column:
    """Text by patterns alone, for where no parser may run."""
    t = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style|noscript|template|svg)[^>]*>.*?</\1>", " ")
    t = F.regexp_replace(t, "(?i)</(p|div|li|br|h[1-6]|tr)>", "\n")
    t = F.regexp_replace(t, "(?s)<[^>]+>", " ")
    t = F.regexp_replace(F.regexp_replace(t, "[ \\t\\u00a0]+", " "), " *\\n *", "\n")
    return F.regexp_replace(F.regexp_replace(t, "\\n{3,}", "\n\n"), r"^\s+|\s+$", "")


@F.pandas_udf(T.StringType())
def readable(html: pd.Series) -> pd.Series:
    return html.map(lambda h: None if h is None else readable_text(h))


def _section_level(n: Node) -> bool:
    return n.tag in SECTION_TAGS or n.attrs.get("role") == "heading"


def _label(n: Node, ids: dict[str, Node], labels: dict[str, Node]) -> str:
    if (own := labels.get(n.attrs.get("id") or "")) and (t := own.text()):
        return t[:MAX_LABEL]
    if aria := n.attrs.get("aria-label", "").strip():
        return aria[:MAX_LABEL]
    parts = [ids[k].text() for k in n.attrs.get("aria-labelledby", "").split() if k in ids]
    if t := " ".join(p for p in parts if p):
        return t[:MAX_LABEL]
    wrap = next((p for p in n.up() if p.tag == "label"), None)
    if wrap is not None and (t := wrap.text(frozenset(("input", "select", "textarea", "button")))):
        return t[:MAX_LABEL]
    node: Node | None = n
    for _ in range(LABEL_DEPTH):
        if node is None:
            break
        for s in node.before():
            leaf = not any(isinstance(x, Node) for x in s.children)
            if leaf and not _section_level(s) and (t := s.text()) and len(t) <= MAX_LABEL:
                return t
        node = node.parent
    return ""


def _section(n: Node) -> str:
    for p in n.up():
        if p.tag == "fieldset":
            if (legend := next((x for x in p.walk() if x.tag == "legend"), None)) and (t := legend.text()):
                return t[:MAX_LABEL]
            break
    node = n.parent
    for _ in range(LABEL_DEPTH):
        if node is None:
            break
        for s in node.before():
            if _section_level(s) and (t := s.text()):
                return t[:MAX_LABEL]
        node = node.parent
    return ""


def _help(n: Node, ids: dict[str, Node]) -> str:
    parts = [ids[k].text() for k in n.attrs.get("aria-describedby", "").split() if k in ids]
    if t := " ".join(p for p in parts if p):
        return t[:MAX_HELP]
    if t := n.attrs.get("title", "").strip():
        return t[:MAX_HELP]
    kin = [x for x in n.parent.children if isinstance(x, Node)] if n.parent else []
    after = kin[kin.index(n) + 1 :][:1]
    if after and after[0].tag not in ("input", "select", "textarea", "button") and (t := after[0].text()) and len(t) <= MAX_HELP:
        return t
    return ""


def controls(html: str | None) -> list[dict]:
    """Form controls of a page, in order."""
    root = parse(html)
    nodes = list(root.walk())
    ids: dict[str, Node] = {}
    for n in nodes:
        if n.attrs.get("id"):
            ids.setdefault(n.attrs["id"], n)
    labels: dict[str, Node] = {}
    for n in nodes:
        if n.tag == "label" and n.attrs.get("for"):
            labels.setdefault(n.attrs["for"], n)
    out = []
    for n in nodes:
        editable = n.attrs.get("contenteditable") in ("true", "") if "contenteditable" in n.attrs else False
        editable = editable or (n.attrs.get("role") == "textbox" and n.tag not in ("input", "textarea"))
        if n.tag not in ("input", "textarea", "select") and not editable:
            continue
        kind = "text" if editable else (n.attrs.get("type") or "text").lower()
        if "hidden" in n.attrs or n.attrs.get("aria-hidden") == "true" or (n.tag == "input" and kind == "hidden"):
            continue
        if len(out) >= MAX_FIELDS:
            break
        readonly = n.tag in ("input", "textarea") and "readonly" in n.attrs
        disabled = n.tag in ("input", "textarea", "select") and "disabled" in n.attrs
        options: list[str] = []
        if n.tag == "select":
            options = [x.text() for x in n.walk() if x.tag == "option"]
        elif n.tag == "input" and kind in ("radio", "checkbox"):
            name = n.attrs.get("name")
            group = [x for x in nodes if x.tag == "input" and x.attrs.get("type") == kind and x.attrs.get("name") == name] if name else [n]
            options = [_label(x, ids, labels) or (x.attrs.get("value", "") if name else "") for x in group]
        if n.tag == "select":
            value = next((x.text() for x in n.walk() if x.tag == "option" and "selected" in x.attrs), "")
        elif n.tag == "input" and kind in ("radio", "checkbox"):
            value = (n.attrs.get("value") or "checked") if "checked" in n.attrs else ""
        elif n.tag == "input":
            value = n.attrs.get("value", "")
        else:
            value = "".join(n.strings())
        most = n.attrs.get("maxlength", "").strip()
        own, name = n.attrs.get("id", ""), n.attrs.get("name", "")
        selector = n.tag
        if own and not own[0].isdigit() and sum(x.attrs.get("id") == own for x in nodes) == 1:
            selector = f"#{own}"
        elif name and sum(x.tag == n.tag and x.attrs.get("name") == name for x in nodes) == 1:
            selector = f'{n.tag}[name="{name}"]'
        out.append(
            {
                "idx": len(out), "field_id": "", "tag": "contenteditable" if editable else n.tag, "type": kind, "name": name, "id": own,
                "label": _label(n, ids, labels), "placeholder": n.attrs.get("placeholder", ""), "aria_label": n.attrs.get("aria-label", ""),
                "required": "required" in n.attrs or n.attrs.get("aria-required") == "true",
                "max_length": int(most) if re.fullmatch(r"[0-9]{1,9}", most) else None,
                "options": [x for x in options if x][:MAX_OPTIONS], "help_text": _help(n, ids),
                "current_value": "" if kind in SECRET_TYPES or readonly or disabled else value[:MAX_VALUE],
                "readonly": readonly, "disabled": disabled, "section_context": _section(n), "selector": selector,
            }
        )
    return out


def scan_controls(pages: DataFrame, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """One row per form control of each page (a page without any gives none)."""
    names = [x.split()[0] for x in FIELD_SCHEMA.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [{"page_id": p, **c} for p, h in zip(pdf["page_id"], pdf["html"], strict=True) for c in controls(h)]
            out = pd.DataFrame(rows, columns=names)
            out["max_length"] = out["max_length"].astype("Int32")
            yield out

    return pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(html).alias("html")).mapInPandas(run, FIELD_SCHEMA)
