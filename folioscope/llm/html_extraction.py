"""Operator 7: main text of web pages by wrappers, union-free regular expressions inferred per host.

A page is read as the stream of its text slots, each named by the path of elements it stands in; a run of slots at one
path is a repeated group. Equal streams of a host are one row before anything is aligned. Then, round by round, the
streams of a host are dealt to small buckets, and each bucket is folded into one wrapper: two streams are aligned
(longest common subsequence), a path on both sides is kept, repeated if either repeats it, and a path on one side only
becomes an optional group. Texts that differ at a path are a text slot; a text that every page has there is template.

When one wrapper per host is left, it decides what is content. A page that has the wrapper's main element (article or
main) gives the slots within it. Other pages give all their slots without the template: texts at a path that all pages
with that path share, on three different pages or more. If nothing but template is there, it stays. Slots within menus,
headers (also an article's own), footers, asides, notices, adverts, forms or comments are never content, whether the
element or one of its names says so. Names are classes and roles with their digits blanked; of ids only such names of
page furniture are read, so an id that names one page is no part of a path.

Extraction reads each page again and keeps its content in page order. A null page or one without content has an empty
text; pages without a host share a wrapper. Comments, scripts and the like vanish without a blank.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import materialised, row_groups

#: Streams that are folded at once.
BUCKET = 32
#: So many different pages must share a text before it is template.
TEMPLATE_PAGES = 3

# HTML's elements by role.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head "
    "header hr html li main nav ol p pre section table tbody td tfoot th thead title tr ul".split()
)
CLOSES_P = BLOCK - {"head", "title"}
SILENT = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|iframe|svg|textarea|select)\b.*?(?:</\1\s*>|\Z)|<!\w[^>]*>|<\?[^>]*>", re.S | re.I)
TOKEN = re.compile(r"<(/?)([a-zA-Z][\w:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|([^<]+|<)")
NAMED = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
ASIDE_TAGS = frozenset("nav header footer aside form button head title dialog menu".split())
ASIDE_NAMES = re.compile(
    r"(?:^|[-_\s])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|notice|popup|modal|comments?|replies|respond|"
    r"sidebar|side|menu|nav\w*|breadcrumbs?|footer|header|share|sharing|social|related|newsletter|subscribe|login|search|"
    r"pagination|pager|widget|toolbar|masthead|complementary|contentinfo|navigation)(?:$|[-_\s])", re.I,
)
MAIN = ("article", "main")


def slots(page: str | None) -> list[tuple[str, str]]:
    """(path, text) of the text slots: white space is one space, references are decoded, empty slots are left out."""
    out: list[tuple[str, str]] = []
    stack: list[tuple[str, str]] = []
    texts: list[str] = []

    def flush() -> None:
        if texts:
            text = " ".join(html.unescape("".join(texts)).split())
            if text:
                out.append(("/".join(label for _, label in stack if label), text))
            texts.clear()

    for match in TOKEN.finditer(SILENT.sub("", page or "")):
        closing, tag, rest, text = match.groups()
        if text is not None:
            texts.append(text)
            continue
        tag = tag.lower()
        if tag not in BLOCK:
            if tag == "br":
                texts.append(" ")
            elif tag == "button" or tag == "dialog" or tag == "menu":
                flush()
                if not closing:
                    stack.append((tag, tag))
                else:
                    pop(stack, tag)
            continue
        flush()
        if closing:
            pop(stack, tag)
            continue
        if tag in CLOSES_P and any(name == "p" for name, _ in stack):
            pop(stack, "p")
        if tag == "li" and stack and stack[-1][0] == "li":
            stack.pop()
        if tag not in VOID and not rest.rstrip().endswith("/"):
            stack.append((tag, ".".join([tag, *filter(None, [names(rest)])])))
    flush()
    return out


def names(attributes: str) -> str:
    """The names of an element without what belongs to one page: digits, and ids that are no page furniture."""
    out = []
    for match in NAMED.finditer(attributes):
        value = next(filter(None, match.groups()[1:]), "")
        if match[1].lower() != "id" or ASIDE_NAMES.search(value):
            out.append(" ".join(re.sub(r"\d+", "#", value).replace("/", " ").split()))
    return " ".join(filter(None, out))


def pop(stack: list[tuple[str, str]], tag: str) -> None:
    for i in range(len(stack) - 1, -1, -1):
        if stack[i][0] == tag:
            del stack[i:]
            return


def stream(found: list[tuple[str, str]]) -> list[tuple[str, bool, bool]]:
    """(path, repeated, optional), one per run of slots at a path."""
    out: list[tuple[str, bool, bool]] = []
    for path, _ in found:
        if out and out[-1][0] == path:
            out[-1] = (path, True, False)
        else:
            out.append((path, False, False))
    return squeezed(out)


def squeezed(items: list[tuple[str, bool, bool]]) -> list[tuple[str, bool, bool]]:
    """A path that comes back is one repeated group at its first place, which bounds a wrapper by its paths."""
    places: dict[str, int] = {}
    out: list[tuple[str, bool, bool]] = []
    for path, repeated, optional in items:
        if path in places:
            at = places[path]
            out[at] = (path, True, out[at][2] and optional)
        else:
            places[path] = len(out)
            out.append((path, repeated, optional))
    return out


def folded(a: list[tuple[str, bool, bool]], b: list[tuple[str, bool, bool]]) -> list[tuple[str, bool, bool]]:
    """Align two wrappers; what only one side has becomes optional."""
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i][0] == b[j][0] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < n and j < m:
        if a[i][0] == b[j][0]:
            out.append((a[i][0], a[i][1] or b[j][1], a[i][2] or b[j][2]))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            out.append((a[i][0], a[i][1], True))
            i += 1
        else:
            out.append((b[j][0], b[j][1], True))
            j += 1
    out += [(p, r, True) for p, r, _ in a[i:]] + [(p, r, True) for p, r, _ in b[j:]]
    return squeezed(out)


def written(wrapper: list[tuple[str, bool, bool]]) -> str:
    """A wrapper as text, one slot a line: ``+`` repeated, ``?`` optional."""
    return "\n".join(path + "\t" + ("+" if repeated else "") + ("?" if optional else "") for path, repeated, optional in wrapper)


def read(text: str) -> list[tuple[str, bool, bool]]:
    rows = [line.rpartition("\t") for line in text.split("\n")] if text else []
    return [(path, "+" in marks, "?" in marks) for path, _, marks in rows]


def content_paths(wrapper: list[tuple[str, bool, bool]]) -> set[str]:
    """The paths of a wrapper that hold main text."""
    def parts(path: str) -> list[tuple[str, str]]:
        return [(label.partition(".")[0], label.partition(".")[2]) for label in path.split("/") if label]

    def main_at(path: str) -> int:
        return next((i for i, (tag, _) in enumerate(parts(path)) if tag in MAIN), -1)

    inside = any(main_at(path) >= 0 for path, _, _ in wrapper)
    out = set()
    for path, _, _ in wrapper:
        labels, at = parts(path), main_at(path)
        if inside and at < 0:
            continue
        if any(tag in ASIDE_TAGS or (names and ASIDE_NAMES.search(names)) for tag, names in labels):
            continue
        out.add(path)
    return out


def in_main(path: str) -> bool:
    return any(label.partition(".")[0] in MAIN for label in path.split("/"))


def fingerprint(text: str) -> str:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()


#: By path: the number of pages with it, and the texts that all of them have there.
Template = dict[str, tuple[int, set[str]]]


def template(found: list[tuple[str, str]]) -> Template:
    """The texts of one page by path. A page with a main element needs none: the element decides."""
    out: Template = {}
    if not any(in_main(path) for path, _ in found):
        for path, text in found:
            out.setdefault(path, (1, set()))[1].add(fingerprint(text))
    return out


def shared(a: Template, b: Template) -> Template:
    """What both sides have at a path; a path of one side only is optional and keeps its texts."""
    both = {path: (a[path][0] + b[path][0], a[path][1] & b[path][1]) for path in a.keys() & b.keys()}
    return {**a, **b, **both}


def template_written(texts: Template) -> str:
    return "\n".join(f"{path}\t{n}\t{' '.join(sorted(held))}" for path, (n, held) in sorted(texts.items()))


def template_read(text: str) -> Template:
    rows = [line.rsplit("\t", 2) for line in text.split("\n")] if text else []
    return {path: (int(n), set(held.split())) for path, n, held in rows}


class Wrapper:
    """A host's wrapper, ready to extract."""

    def __init__(self, wrapper: str, texts: str):
        items = read(wrapper)
        self.main = content_paths(items)
        self.rest = content_paths([item for item in items if not in_main(item[0])])
        self.template = {p: held for p, (n, held) in template_read(texts).items() if n >= TEMPLATE_PAGES and held}

    def main_text(self, page: str | None) -> str:
        found = slots(page)
        paths = self.main if any(in_main(path) for path, _ in found) else self.rest
        content = [(path, text) for path, text in found if path in paths]
        if paths is self.rest and self.template:
            own = [s for s in content if s[0] not in self.template or fingerprint(s[1]) not in self.template[s[0]]]
            content = own or content
        return "\n\n".join(text for _, text in content)


def wrappers(pages: DataFrame, host: str = "host", page: str = "html", bucket: int = BUCKET) -> DataFrame:
    """``host, wrapper, texts`` of ``pages``; hosts must not be null."""
    names, schema = ["host", "place", "wrapper", "texts"], "host string, place long, wrapper string, texts string"

    def streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [slots(p) for p in batch.column(1).to_pylist()]
            columns = [
                batch.column(0), pa.array([0] * len(found), pa.int64()),
                pa.array([written(stream(f)) for f in found], pa.string()),
                pa.array([template_written(template(f)) for f in found], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in row_groups(batches, 2):
            merged: list[tuple[str, bool, bool]] | None = None
            texts: Template = {}
            for wrapper, held in zip(table.column(2).to_pylist(), table.column(3).to_pylist(), strict=True):
                own = read(wrapper)
                merged = own if merged is None else folded(merged, own) if own != merged else merged
                texts = shared(texts, template_read(held))
            row = [table.column(0)[0].as_py(), table.column(1)[0].as_py(), written(merged or []), template_written(texts)]
            yield pa.RecordBatch.from_pydict({n: [v] for n, v in zip(names, row, strict=True)}, pa.schema(
                [("host", pa.string()), ("place", pa.int64()), ("wrapper", pa.string()), ("texts", pa.string())]
            ))

    rows = pages.select(F.col(host).alias("host"), F.col(page).alias("page"))
    current = materialised(rows.mapInArrow(streams, schema).distinct(), "wrapper_streams")
    while True:
        sizes = current.groupBy("host").agg(F.count("*").alias("n"))
        most = sizes.agg(F.max("n")).first()[0] or 0
        if most <= 1:
            return current.select("host", "wrapper", "texts")
        # Equal wrappers of different buckets part here, as their buckets differ.
        place = F.pmod(F.xxhash64("wrapper", "texts", "place"), F.ceil(F.col("n") / bucket)).cast("long")
        dealt = current.join(sizes, "host").select("host", place.alias("place"), "wrapper", "texts")
        dealt = dealt.repartition("host", "place").sortWithinPartitions("host", "place", "wrapper", "texts")
        current = materialised(dealt.mapInArrow(fold, schema), "wrapper_round")


def main_texts(pages: DataFrame, page: str = "html", url: str = "url", name: str = "text") -> DataFrame:
    """``pages`` without ``page`` and with the main text in ``name``."""
    host = F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))
    kept = [c for c in pages.columns if c not in (page, name)]
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("all"), host.alias("host"), F.col(page).alias("page"))
    found = materialised(wrappers(rows, "host", "page"), "wrappers")
    joined = rows.join(found, "host", "left").select("wrapper", "texts", "page", "all")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[str | None, str | None], Wrapper] = {}
        for batch in batches:
            texts = []
            for wrapper, held, content in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                if (wrapper, held) not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[wrapper, held] = Wrapper(wrapper or "", held or "")
                texts.append(known[wrapper, held].main_text(content))
            yield pa.RecordBatch.from_arrays([batch.column(3), pa.array(texts, pa.string())], names=["all", "main"])

    schema = joined.select("all").schema.add("main", "string")
    out = joined.mapInArrow(extract, schema)
    return out.select(*[F.col("all")[c].alias(c) for c in kept], F.col("main").alias(name))
