"""Main text of web pages by composite text density.

Every element gets a density: characters for each tag, scaled by how many of
them stand in links, against the share of link characters of the whole body.
An element's density sum is that of its children.  The element with the
largest sum leads to a threshold, the least density on its path up to the
body; then every branch whose density reaches the threshold gives its subtree
with the largest sum.  The densities choose the container only: of the article or
main element that the largest sum stands in, all blocks stay but navigation, also
short ones in wrappers of their own; where there is none, so do the blocks beside
the largest sum, and headed sections further out.  Elements that are never an article's own text (scripts,
menus, fields and the like) are set aside before densities are taken.  A form,
or a word of class, id or role that names such a part (also a comment thread),
is a hint only: see Page._set_aside for what stays in spite of it.

Nulls and ties: a null page is an empty one and its text is empty; of equal
sums the outer, then the earlier element wins; markup that is cut off or not
closed is read as far as it goes; rows are pages of their own, also when they
repeat; an empty table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

import html
import math
import re

import pandas as pd
from pyspark.sql import DataFrame

# Element names of the public HTML standard, and class words of page furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
DROPPED = frozenset("""head script style noscript template textarea title iframe object embed svg canvas audio video map nav header
footer aside button select option input label fieldset datalist dialog menu""".split())
BLOCK = frozenset("""address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure
footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot
th thead tr ul""".split())
CLOSES_P = BLOCK - frozenset("br option tbody td tfoot th thead tr caption legend".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
            "option": ("option",)}
SCOPES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"),
          "option": ("select",)}
FURNITURE = frozenset("""ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent
gdpr notice notices alert popup modal overlay nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar aside widget
footer header masthead toolbar pagination pager share sharing social related recommended newsletter subscribe signup login comment
comments disqus respond replies skip search contentinfo complementary""".split())
TOKEN = re.compile(
    r"<!--(?:.*?-->|.*\Z)|<!\[CDATA\[(?:.*?\]\]>|.*\Z)|<[!?](?:[^>]*>|[^>]*\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)(?:>|\Z)", re.S)
NAMING = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
WORD = re.compile(r"[A-Za-z]+")
WITHOUT = re.compile(r"(?<![a-z])(?:has|no|with|without)[-_]\S*")  # says what is beside an element, not what it is
# A class of these says what the text is about as often as what it is: only whole names count, not parts of them.
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd td th figcaption".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
TALK = frozenset("comment comments disqus respond replies".split())


class Page:
    """Elements in document order; texts belong to the element they stand in."""

    def __init__(self, source: str):
        self.tags, self.parents, self.dropped = ["html"], [-1], [False]
        self.hints: dict[int, frozenset[str]] = {}
        self.parts: list[tuple[int, str | None]] = []  # (element, text); None: a block edge
        self.body = 0
        self._read(source)
        if self.hints:
            self._set_aside()

    def _open(self, stack: list[int], tag: str, attributes: str) -> int:
        node = len(self.tags)
        self.tags.append(tag)
        self.parents.append(stack[-1])
        self.dropped.append(self.dropped[stack[-1]] or tag in DROPPED)
        if not self.dropped[node] and tag not in ("html", "body"):
            names = [WITHOUT.sub(" ", "".join(v).lower()) for _, *v in NAMING.findall(attributes)]
            words = {w for v in names for w in (v.split() if tag in TEXTUAL else WORD.findall(v))} & FURNITURE
            if words or tag == "form":
                self.hints[node] = frozenset(words or {tag})
        return node

    def _read(self, source: str) -> None:
        stack, at = [0], 0
        while at < len(source):
            found = TOKEN.search(source, at)
            text = source[at:found.start()] if found else source[at:]
            if text:
                self.parts.append((stack[-1], html.unescape(text) if "&" in text else text))
            if not found:
                break
            at = found.end()
            tag = (found[2] or "").lower()
            if not tag:
                continue
            if tag in BLOCK:
                self.parts.append((stack[-1], None))
            if found[1]:
                self._close(stack, tag)
                continue
            if tag == "html":
                continue
            self._imply(stack, tag)
            node = self._open(stack, tag, found[3])
            if tag == "body" and not self.body:
                self.body = node
            if tag in RAW:
                end = re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(source, at)
                at = end.end() if end else len(source)
            elif tag not in VOID and not found[3].endswith("/"):
                stack.append(node)

    def _close(self, stack: list[int], tag: str) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if self.tags[stack[k]] == tag:
                del stack[k:]
                return

    def _imply(self, stack: list[int], tag: str) -> None:
        """Close what the new element ends: an open paragraph, or the item before it in a list or table."""
        ends, scopes = SIBLINGS.get(tag), SCOPES.get(tag, ())
        for k in range(len(stack) - 1, 0, -1):
            here = self.tags[stack[k]]
            if ends and here in ends or tag in CLOSES_P and here == "p":
                del stack[k:]
                if not ends:
                    return
            elif here in scopes or here in CLOSES_P and not ends:
                return

    def _set_aside(self) -> None:
        """Drop hinted elements, but those that the article stands in.

        Kept are: article and main elements themselves; what holds the page's
        main or article element (the one with most prose, if that is a quarter
        of the prose without a hint at least); and, while there are such, all
        elements of the same words that together hold more prose than all that
        has no hint.  Outside the main element, and for comment threads, it must
        be four times as much; a thread beside a main element never stays.
        Prose is what stands in no link.  Hints within kept elements are judged anew.
        """
        n, tags, parents, dropped = len(self.tags), self.tags, self.parents, self.dropped
        prose, in_link, talk, children = [0] * n, [False] * n, [False] * n, [[] for _ in tags]
        for k in range(1, n):
            p = parents[k]
            in_link[k] = in_link[p] or tags[k] == "a"
            talk[k] = talk[p] or k in self.hints and bool(self.hints[k] & TALK)
            if not dropped[k]:
                children[p].append(k)
        for node, text in self.parts:
            if text and not dropped[node] and not in_link[node]:
                prose[node] += len("".join(text.split()))
        for k in range(n - 1, 0, -1):
            prose[parents[k]] += prose[k]
        plain, groups = 0, {}

        def enter(top: int) -> None:
            """Count what has no hint below an element and gather the next hinted ones."""
            nonlocal plain
            plain, todo = plain + prose[top], list(children[top])
            while todo:
                k = todo.pop()
                if k in self.hints and tags[k] not in ("article", "main"):
                    plain -= prose[k]
                    groups.setdefault(self.hints[k], set()).add(k)
                else:
                    todo += children[k]

        enter(0)
        main = max((k for k in range(n) if tags[k] in ("article", "main") and prose[k] and not dropped[k] and not talk[k]
                    and k not in self.hints), key=lambda k: (prose[k], -k), default=0)
        if tags[main] == "article" and 4 * prose[main] < plain:
            main = 0
        path, k = [], main
        while k:
            k = parents[k]
            path.append(k)
        for k in reversed(path):
            if k in self.hints and k in groups.get(self.hints[k], ()):
                groups[self.hints[k]].remove(k)
                enter(k)
        within = [False] * n
        for k in range(1, n):
            within[k] = k == main or within[parents[k]]
        while True:
            held = {w: sum(prose[k] for k in g) for w, g in groups.items()}
            for words in sorted(groups, key=lambda w: (-held[w], min(groups[w], default=n))):
                beside = bool(main) and not all(within[k] for k in groups[words])
                thread = any(talk[k] for k in groups[words])
                if held[words] > plain * (4 if beside or thread else 1) and not (beside and thread):
                    break
            else:
                break
            for k in groups.pop(words):
                enter(k)
        for group in groups.values():
            for k in group:
                dropped[k] = True
        for k in range(1, n):
            dropped[k] = dropped[k] or dropped[parents[k]]

    def densities(self) -> tuple[list[float], list[float]]:
        """(density, density sum) of each element."""
        n = len(self.tags)
        chars, links, tags, anchors, in_link = [0] * n, [0] * n, [0] * n, [0] * n, [False] * n
        for k in range(1, n):
            in_link[k] = in_link[self.parents[k]] or self.tags[k] == "a"
        for node, text in self.parts:
            if text and not self.dropped[node]:
                size = len("".join(text.split()))
                chars[node] += size
                links[node] += size * in_link[node]
        for k in range(n - 1, 0, -1):
            p = self.parents[k]
            chars[p] += chars[k]
            links[p] += links[k]
            if not self.dropped[k]:
                tags[p] += tags[k] + 1
                anchors[p] += anchors[k] + (self.tags[k] == "a")
        # many links and hardly any other text
        self.listing = [anchors[k] >= 3 and 5 * links[k] > 4 * chars[k] for k in range(n)]
        self.chars = chars
        share = links[self.body] / max(chars[self.body], 1)
        density, sums = [0.0] * n, [0.0] * n
        for k in range(n - 1, -1, -1):
            c, lc, t, lt = chars[k], max(links[k], 1), max(tags[k], 1), max(anchors[k], 1)
            if c and not self.dropped[k]:
                base = math.log(c / max(c - links[k], 1) * links[k] + share * c + math.e)
                scale = math.log(max(c / lc * t / lt, 1.0) + 1e-9) / max(math.log(base), 1e-3) if base > 1.001 else math.log(c * t + 1)
                density[k] = c / t * max(scale, 0.0)
            if k:
                # inline elements are no children of their own: what they hold counts for the block around them
                sums[self.parents[k]] += density[k] if self.tags[k] in BLOCK else sums[k]
        return density, sums

    def selected(self) -> list[bool]:
        """Which elements are in a chosen subtree."""
        density, sums = self.densities()
        n, children = len(self.tags), [[] for _ in self.tags]
        for k in range(1, n):
            children[self.parents[k]].append(k)
        # the best block of each subtree, itself included; the outer and earlier of equals
        best = list(range(n))
        worth = [sums[k] if self.tags[k] in BLOCK or k in (0, self.body) else -1.0 for k in range(n)]
        for k in range(n - 1, -1, -1):
            for c in children[k]:
                if not self.dropped[c] and worth[best[c]] > worth[best[k]]:
                    best[k] = best[c]
        top = best[self.body]
        threshold, k = density[top], top
        while k != self.body and k > 0:
            k = self.parents[k]
            threshold = min(threshold, density[k])
        inside = [False] * n
        if density[self.body] > 0:
            todo = [self.body]
            while todo:
                k = todo.pop()
                if self.dropped[k] or density[k] < threshold:
                    continue
                inside[best[k]] = True
                if best[k] != k:
                    todo += [c for c in children[k] if c != best[k]]
        for k in range(1, n):
            inside[k] = (inside[k] or inside[self.parents[k]]) and not self.dropped[k]
        more = self._around(top, children, inside)
        for k in range(1, n):
            p = self.parents[k]
            # a listing beside what the densities chose is navigation
            more[k] = (more[k] or more[p] and not self.listing[k]) and not self.dropped[k]
        return [a or b for a, b in zip(inside, more, strict=True)]

    def _around(self, top: int, children: list[list[int]], inside: list[bool]) -> list[bool]:
        """What belongs to the article around its densest part; the elements below follow."""
        out, path = [False] * len(self.tags), [top]
        while path[-1] != self.body and self.parents[path[-1]] > 0:
            path.append(self.parents[path[-1]])
        own = [k for k in path if self.tags[k] in ("article", "main")]
        if own:
            # the article; a main element around it as well, unless it holds other articles
            articles = sum(self.tags[k] == "article" and self.chars[k] > 0 and not self.dropped[k] for k in self._below(own[-1], children))
            out[own[-1] if articles < 2 else own[0]] = True
            return out
        for k, outer in zip(path, path[1:], strict=False):
            for c in children[outer]:
                if c == k or self.dropped[c] or self.listing[c] or not self.chars[c] or inside[c]:
                    continue
                tags = {self.tags[c], *(self.tags[x] for x in self._below(c, children) if not self.dropped[x])}
                near = k == top and outer != self.body
                out[c] = bool(tags & (TEXTUAL if near else HEADINGS)) and (near or "p" in tags or self.tags[c] in HEADINGS)
        return out

    def _below(self, k: int, children: list[list[int]]) -> list[int]:
        out, todo = [], list(children[k])
        while todo:
            out.append(todo.pop())
            todo += children[out[-1]]
        return out

    def text(self) -> str:
        inside, blocks, line = self.selected(), [], []
        for node, text in [*self.parts, (0, None)]:
            if text is None:
                block = " ".join("".join(line).split())
                if block:
                    blocks.append(block)
                line = []
            elif inside[node]:
                line.append(text)
        return "\n".join(blocks)


def main_text(source: str | None) -> str:
    return Page(source).text() if source else ""


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    def run(batches):
        for batch in batches:
            texts = [main_text(h) for h in batch["html"]]
            yield pd.DataFrame({"page_id": batch["page_id"].astype("Int64"), "url": batch["url"], "text": texts,
                                "n_chars": [len(t) for t in texts]})

    return pages.select("page_id", "url", "html").mapInPandas(run, "page_id long, url string, text string, n_chars long")
