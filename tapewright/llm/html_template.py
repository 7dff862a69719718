"""Main text of web pages by template deduction over the pages of a host.

Tokens are opening and closing tags and pieces of text, told apart by where they stand. Tokens of a host that stand as
often as each other on each of its pages - those with one occurrence vector - are an equivalence class. A class is valid
if it stands on many pages, has several tokens, and these keep their order. The largest class that stands once on a page
is the root of the template; any other is nested into it if all of its tokens lie in one gap between two neighbours of
the root. The text of valid classes is template; what is left are the slots.

Which slots are the article isn't told by vectors: the root's innermost article or main element is, where there is one;
else all slots but those whose text is mostly links. Elements that are no article by their tag, role, class or id (fixed
lists below) are dropped in either case, as menus and adverts of most hosts vary from page to page.

A vector is kept as its fingerprint, a sum over the pages of hashes of (page, count), so it is counted in tasks first
and a host may have any number of pages. Pages are parsed three times (vectors, order and gaps, text) and never shuffled.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewright.llm.common import join_spread, written
from tapewright.llm.url_graph import host

#: A class of the template stands on this share of the host's pages at least, and has so many tokens.
SUPPORT, LEAST_TOKENS = 0.5, 2
#: On a host of fewer pages no template is deduced.
LEAST_PAGES = 3
#: A token is in order (in one gap) if it is so on this share of the pages with it.
ORDERED = 0.9
#: A slot of which this share of the characters are links is a menu.
LINKED = 0.5
#: Kinds of tokens; one of MAIN and more may hold the article, the deeper the higher.
PAGE, TEXT, TAG, MAIN_FROM = -1, 0, 1, 2
_VECTOR = (1 << 40) - 1
_END = 0x5BD1E995
#: Elements of an article's own text: what varies on no page is kept in them, and dropped in others inside the article.
WRITTEN = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "blockquote", "hgroup", "li", "dt", "dd", "tr", "td", "th", "caption", "figcaption", "html", "body", "article", "main"}
MAIN = ("article", "main")
DROPPED = {"nav", "footer", "aside", "form", "script", "style", "noscript", "template", "iframe", "svg", "button", "select", "textarea", "head", "title", "dialog", "menu", "object", "canvas"}
DROPPED_NAMES = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|nav\w*|menu\w*|side-?bar|breadcrumbs?|comments?|disqus|replies|cookies?|consent|notice|newsletter|subscribe|share|sharing|social|related|footer|popup|modal|login|signup)(?:$|[\s_-])", re.I)
DROPPED_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
_RAW = ("script", "style", "textarea", "title", "noscript", "iframe")
_token = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<raw>" + "|".join(_RAW) + r")\b(?P<rawattrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>",
    re.I | re.S,
)
_attr = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_closed_by = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


def attributes(text: str) -> dict[str, str]:
    return {k.lower(): html.unescape(v.strip("\"'")) for k, v in _attr.findall(text)} if text.strip("/ ") else {}


def events(page: str):
    """(kind, token, attributes, text) in page order: open and close of elements, text pieces. Elements left open are closed where HTML would."""
    stack: list[str] = []
    at = 0

    def pop_to(i: int):
        while len(stack) > i:
            yield "close", stack.pop(), {}, ""

    for m in _token.finditer(page):
        if m.start() > at:
            yield "text", "", {}, page[at : m.start()]
        at = m.end()
        if m["raw"]:
            continue
        if not m["name"]:
            continue
        name = m["name"].lower()
        if m["close"]:
            if name in stack:
                yield from pop_to(len(stack) - 1 - stack[::-1].index(name))
            continue
        if name not in INLINE and name != "br" and "p" in stack:
            yield from pop_to(len(stack) - 1 - stack[::-1].index("p"))
        for other in _closed_by.get(name, ()):
            if other in stack[-3:]:
                yield from pop_to(len(stack) - 1 - stack[::-1].index(other))
        attrs = attributes(m["attrs"])
        if name in VOID or m["attrs"].endswith("/"):
            yield "void", name, attrs, ""
        else:
            stack.append(name)
            yield "open", name, attrs, ""
    if at < len(page):
        yield "text", "", {}, page[at:]


def is_dropped(name: str, attrs: dict[str, str], in_main: bool) -> bool:
    """Whether an element is no part of an article, by its name, role, class or id."""
    if name in DROPPED or name == "header" and not in_main or attrs.get("role", "").lower() in DROPPED_ROLES:
        return True
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", attrs.get("style", ""), re.I):
        return True
    return name not in ("html", "body", *MAIN) and any(DROPPED_NAMES.search(attrs[k]) for k in ("class", "id") if k in attrs)


def _hash(text: str, seed: int) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "replace"), seed) >> 1


def walk(page: str) -> Iterator[tuple[str, str, dict[str, str], str, int]]:
    """The events of a page with their tokens. The token is 0 for white space and for the ends of inline elements."""
    path, opened = [0], []
    for kind, name, attrs, text in events(page):
        if kind == "text":
            words = " ".join(html.unescape(text).split())
            yield kind, name, attrs, text, _hash(words, path[-1]) if words else 0
        elif kind == "close":
            path.pop()
            yield kind, name, attrs, text, 0 if name in INLINE else opened[-1] ^ _END
            opened.pop()
        else:
            token = _hash(f"<{name}.{attrs.get('class', '')}@{attrs.get('role', '').lower()}", path[-1])
            if kind == "open":
                path.append(_hash(name, path[-1]))
                opened.append(token)
            yield kind, name, attrs, text, token


def page_tokens(page: str) -> tuple[list[int], dict[int, int]]:
    """The tokens of a page in order, and the kind of each."""
    order, kinds, path = [], {}, []
    for kind, name, attrs, _, token in walk(page):
        if token:
            order.append(token)
            if token not in kinds:
                main = kind == "open" and (name in MAIN or attrs.get("role", "").lower() == "main") and not DROPPED.intersection(path)
                kinds[token] = TEXT if kind == "text" else MAIN_FROM + len(path) if main else TAG
        if kind == "open":
            path.append(name)
        elif kind == "close":
            path.pop()
    return order, kinds


def vector_part(page: int, count: int) -> tuple[int, int]:
    """What a page adds to the fingerprint of a vector that has that count for it."""
    h = xxhash.xxh3_128_intdigest(page.to_bytes(8, "little", signed=True), count)
    return h & _VECTOR, (h >> 40) & _VECTOR


def _batch(rows: dict, schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*((*k, *v) for k, v in rows.items()), strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, schema.types, strict=True)], schema=schema)


_COUNTED = pa.schema([("host", pa.string()), ("token", pa.int64()), ("kind", pa.int32()), ("pages", pa.int64()), ("n", pa.int64()), ("first", pa.int64()), ("v1", pa.int64()), ("v2", pa.int64())])
_CHECKED = pa.schema([("host", pa.string()), ("kind", pa.int32()), ("token", pa.int64()), ("gap", pa.int64()), ("n", pa.int64()), ("good", pa.int64())])


def token_vectors(pages: DataFrame) -> DataFrame:
    """For each token of each host of pages (host, html, page): pages with it, occurrences, the sum of its first places, and its vector's fingerprint (v1, v2).

    Token 0 counts the pages. Tokens of a single page are left out, unless the host has one page.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict = {}
            for name, text, page in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                order, kinds = page_tokens(text)
                found: dict[int, list[int]] = {}
                for i, token in enumerate(order):
                    if token in found:
                        found[token][1] += 1
                    else:
                        found[token] = [i, 1]
                found[0] = [0, 1]
                parts = {n: vector_part(page, n) for n in {n for _, n in found.values()}}
                for token, (first, n) in found.items():
                    own = sums.setdefault((name, token, kinds.get(token, PAGE)), [0, 0, 0, 0, 0])
                    a, b = parts[n]
                    own[0] += 1
                    own[1] += n
                    own[2] += first
                    own[3] = (own[3] + a) & _VECTOR
                    own[4] = (own[4] + b) & _VECTOR
            yield _batch(sums, _COUNTED)

    rows = pages.mapInArrow(count, "host string, token long, kind int, pages long, n long, first long, v1 long, v2 long")
    mod = lambda c: F.sum(c).bitwiseAND(_VECTOR).alias(c)  # noqa: E731  batches of 40-bit sums: no overflow below 2**23 of them
    summed = rows.groupBy("host", "token").agg(F.max("kind").alias("kind"), F.sum("pages").alias("pages"), F.sum("n").alias("n"), F.sum("first").alias("first"), mod("v1"), mod("v2"))
    return summed.where((F.col("pages") > 1) | (F.col("token") == 0))


def equivalence_classes(vectors: DataFrame) -> DataFrame:
    """host, total, classes: for each host of LEAST_PAGES and more pages its frequent classes of LEAST_TOKENS and more, as array of struct(pages, once, tokens), each token a struct(first, token, kind), in the order of the mean first place."""
    heads = vectors.where(F.col("token") == 0).select("host", F.col("pages").alias("total"))
    often = vectors.where(F.col("token") != 0).join(heads, "host").where((F.col("total") >= LEAST_PAGES) & (F.col("pages") >= SUPPORT * F.col("total")))
    by_vector = often.groupBy("host", "total", "v1", "v2", "pages", "n").agg(F.sort_array(F.collect_list(F.struct("first", "token", "kind"))).alias("tokens"))
    valid = by_vector.where(F.size("tokens") >= LEAST_TOKENS)
    return valid.groupBy("host", "total").agg(F.sort_array(F.collect_list(F.struct("pages", (F.col("n") == F.col("pages")).alias("once"), "tokens"))).alias("classes"))


def draft(classes: list[dict]) -> list[list[list[int]]]:
    """[root, *others] of a host's classes, each a list of [token, kind, once]. The root is the largest that stands once on its pages; it is empty without such a one."""
    once = [c for c in classes if c["once"]]
    root = max(once, key=lambda c: (len(c["tokens"]), c["pages"]), default=None)
    return [[[t["token"], t["kind"], int(c["once"])] for t in c["tokens"]] if c else [] for c in [root, *(c for c in classes if c is not root)]]


@lru_cache(256)
def _read_draft(plan: str) -> tuple[dict[int, int], dict[int, tuple[int, int]], list[int]]:
    """Places of the root's tokens; class and place of all tokens; sizes of the classes."""
    classes = json.loads(plan)
    at = {t: (c, i) for c, tokens in enumerate(classes) for i, (t, *_) in enumerate(tokens)}
    return {t: i for i, (t, *_) in enumerate(classes[0])}, at, [len(c) for c in classes]


def check_page(page: str, plan: str, sums: dict, name: str) -> None:
    """Adds what a page says of its host's draft: for each token and the root's gap that it stands in, occurrences and those in order; for each slot (from one block tag of the root to the next), characters of varying text and those of them that are links."""
    root, at, sizes = _read_draft(plan)
    turns = [0] * len(sizes)
    gap = slot = dropped = linked = 0
    stack: list[tuple[bool, bool]] = []
    for kind, tag, attrs, text, token in walk(page):
        if kind == "open":
            stack.append((is_dropped(tag, attrs, False), tag == "a"))
            dropped += stack[-1][0]
            linked += stack[-1][1]
        elif kind == "close":
            was_dropped, was_link = stack.pop()
            dropped -= was_dropped
            linked -= was_link
        if token in at:
            c, i = at[token]
            own = sums.setdefault((name, 1, token, 0 if c == 0 else gap), [0, 0])
            own[0] += 1
            own[1] += turns[c] % sizes[c] == i
            turns[c] += 1
            if token in root:
                gap = token
                slot = slot if kind == "text" or tag in INLINE else token
        elif kind == "text" and token and not dropped:
            own = sums.setdefault((name, 0, 0, slot), [0, 0])
            own[0] += len(text)
            own[1] += len(text) if linked else 0


def finish(classes: list[list[list[int]]], checked: list[dict]) -> dict:
    """The plan of a host: main (the token of the article's element, or None), template (text tokens), root, and menus (root tags that a slot of links follows).

    A token stays if it is in order, and outside the root also in one gap; a class stays if LEAST_TOKENS of its tokens do,
    all in the same gap.
    """
    seen: dict[int, list[tuple[int, int, int]]] = {}
    slots = {}
    for r in checked:
        if r["kind"]:
            seen.setdefault(r["token"], []).append((r["n"], r["good"], r["gap"]))
        else:
            slots[r["gap"]] = (r["n"], r["good"])
    valid = []
    for c, tokens in enumerate(classes):
        own = []
        for token, kind, once in tokens:
            found = seen.get(token, [])
            total = sum(n for n, *_ in found)
            most, _, gap = max(found, default=(0, 0, 0))
            if total and sum(good for _, good, _ in found) >= ORDERED * total and most >= ORDERED * total:
                own.append((token, kind, once, gap))
        if len(own) >= LEAST_TOKENS and (c == 0 or len({gap for *_, gap in own}) == 1):
            valid.append((c, own))
    main = max(((kind, token) for _, own in valid for token, kind, once, _ in own if kind >= MAIN_FROM and once), default=None)
    root = [token for c, own in valid if c == 0 for token, *_ in own]
    return {
        "main": main and main[1],
        "template": sorted(token for _, own in valid for token, kind, *_ in own if kind == TEXT),
        "root": root if main is None else [],
        "menus": [] if main else [gap for gap, (n, links) in slots.items() if gap in root and links > LINKED * n],
    }


def own_main(page: str) -> int | None:
    """The innermost article or main element of a page without a plan's, if it stands there once."""
    order, kinds = page_tokens(page)
    found = max(((k, t) for t, k in kinds.items() if k >= MAIN_FROM and order.count(t) == 1), default=None)
    return found and found[1]


def main_text(page: str | None, main: int | None = None, template: frozenset = frozenset(), root: frozenset = frozenset(), menus: frozenset = frozenset()) -> str:
    """The text of the slots that a plan keeps: white space made single, blocks parted by a space. Without the plan's element on the page, the body's.

    Template text is left out, in the article only with an element (other than WRITTEN and inline ones) in which nothing
    varies. A page on which nothing varies is read whole.
    """
    if not page:
        return ""

    def read(wanted: int | None, fixed: frozenset, left_out: frozenset) -> tuple[bool, str]:
        out: list[str] = []
        path: list[str] = []
        starts: list[tuple[int, int]] = []
        inside, dropped, seen, varied, slot = 0, 0, False, 0, 0
        for kind, name, attrs, text, token in walk(page):
            if token in root and kind != "text" and name not in INLINE:
                slot = token
            if kind == "text":
                if not dropped and (inside or wanted is None):
                    known = bool(fixed) and (not token or token in fixed)
                    varied += not known
                    if wanted is not None or not (known and token or slot in left_out):
                        out.append(html.unescape(text))
                continue
            if name not in INLINE:
                out.append("\n")
            if kind == "open":
                path.append(name)
                starts.append((len(out), varied))
                if inside:
                    inside += 1
                elif wanted is not None and not dropped and token == wanted:
                    inside, seen = 1, True
                if dropped or is_dropped(name, attrs, inside > 1):
                    dropped += 1
            elif kind == "close":
                path.pop()
                start, before = starts.pop()
                if fixed and inside > 1 and not dropped and varied == before and name not in INLINE and name not in WRITTEN and not set(path[-inside + 1 :]) & {"p", "pre", "blockquote"}:
                    out[start:] = ["\n"]
                inside -= inside > 0
                dropped -= dropped > 0
        return seen, " ".join("".join(out).split())

    def whole(fixed: frozenset, left_out: frozenset) -> str:
        if main is not None:
            seen, text = read(main, fixed, left_out)
            if seen:
                return text
        return read(None, fixed, left_out)[1]

    if main is None and not root:
        main = own_main(page)
    return whole(template, menus) or (whole(frozenset(), frozenset()) if template or menus else "")


def plans(pages: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
    """host, total, plan: the JSON of the plan of each host of pages (host, html, page) with a frequent class, and its number of pages. vectors: those of token_vectors, if at hand."""
    vectors = written(token_vectors(pages)) if vectors is None else vectors

    @F.arrow_udf("string")
    def drafted(classes: pa.Array) -> pa.Array:
        return pa.array([json.dumps(draft(own), separators=(",", ":")) for own in classes.to_pylist()], pa.string())

    drafts = written(equivalence_classes(vectors).select("host", "total", drafted(F.col("classes")).alias("plan")))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict = {}
            for name, text, plan in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                check_page(text, plan, sums, name)
            yield _batch(sums, _CHECKED)

    given = with_plans(pages, drafts).where(F.col("plan").isNotNull()).select("host", "html", "plan")
    checked = given.mapInArrow(check, "host string, kind int, token long, gap long, n long, good long").groupBy("host", "kind", "token", "gap").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    # of a host, as many rows as its drafted tokens, and the gaps that they were seen in
    of_host = checked.groupBy("host").agg(F.collect_list(F.struct("kind", "token", "gap", "n", "good")).alias("checked"))

    @F.arrow_udf("string")
    def finished(plans: pa.Array, checked: pa.Array) -> pa.Array:
        return pa.array([json.dumps(finish(json.loads(p), c), separators=(",", ":")) for p, c in zip(plans.to_pylist(), checked.to_pylist(), strict=True)], pa.string())

    return written(drafts.join(of_host, "host").select("host", "total", finished(F.col("plan"), F.col("checked")).alias("plan")))


def with_plans(pages: DataFrame, plans: DataFrame) -> DataFrame:
    """pages with their host's plan: broadcast if the plans are small, else hosts of many pages are spread."""
    return join_spread(pages, plans.select("host", "plan", "total"), "host", "total", F.length("plan") + F.length("host"), "page")


@lru_cache(256)
def _read_plan(plan: str | None) -> tuple:
    found = json.loads(plan) if plan else {}
    return found.get("main"), *(frozenset(found.get(k, ())) for k in ("template", "root", "menus"))


def extract(text: Column, plan: Column) -> Column:
    @F.arrow_udf("string")
    def read(pages: pa.Array, plans: pa.Array) -> pa.Array:
        return pa.array([main_text(p, *_read_plan(x)) for p, x in zip(pages.to_pylist(), plans.to_pylist(), strict=True)], pa.string())

    return read(text, plan)


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text for each row of pages (page_id, url, html); other columns are left out.

    Null and empty html give an empty text; urls without a host, and null ones, are one host. Repeated rows each count as
    a page and each stay. An empty table gives no row.
    """
    own = pages.select("page_id", "url", "html", host(F.col("url")).alias("host"), F.xxhash64("page_id", "url", "html").alias("page"))
    found = plans(own.where(F.length("html") > 0).select("host", "html", "page"))
    return with_plans(own, found).select("page_id", "url", extract(F.col("html"), F.col("plan")).alias("text"))
