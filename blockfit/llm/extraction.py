"""Main text of web pages by a site style tree.

The pages of a host are merged into one tree of element paths. A path is presented in several ways
(sequences of child elements) and holds several contents; both are variety, measured as entropy over
the host's pages. Navigation, advertising and notices look and read alike on many pages, so their
branches have low importance and are cut from each page, inside declared main parts as well. ``article``
and ``main`` raise the importance of what they hold, as so many pages more would; what HTML declares to be
something else (``nav``, ``footer`` ...) goes in any case. A host of few pages has only the declarations.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blockfit.llm.common import column_of, stored

#: Elements by their part in HTML. Fixed values of the standard.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea noscript template iframe svg math title xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th "
    "thead tr ul option select button".split()
)
NEVER = frozenset(
    "head nav header footer aside form button select menu dialog input script style textarea noscript template iframe "
    "svg math title object embed canvas audio video".split()
)
MAIN = frozenset("article main".split())
#: Their classes describe the layout of the page.
FRAME = MAIN | {"html", "body"}
#: Closed by the start of one of the others.
CLOSES = {
    "p": BLOCK - {"br"},
    "li": frozenset({"li"}),
    "dt": frozenset({"dt", "dd"}),
    "dd": frozenset({"dt", "dd"}),
    "tr": frozenset({"tr", "tbody", "tfoot"}),
    "td": frozenset({"td", "th", "tr", "tbody", "tfoot"}),
    "th": frozenset({"td", "th", "tr", "tbody", "tfoot"}),
    "option": frozenset({"option"}),
}
#: Words in class, id or role that mark what a branch is; a class of several words marks if all do, so
#: that ``has-sidebar`` or ``site-header-fixed`` say nothing.
_NOISE_WORD = (
    r"(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookie\w*|consent|gdpr|notice|popup|modal|newsletter|subscribe|"
    r"nav\w*|menu|breadcrumbs?|sidebar|side|widget|footer|foot|header|masthead|comments?|disqus|replies|reply|respond|"
    r"share|sharing|social|related|recommend\w*|login|signup|search|pagination|pager|complementary|contentinfo|"
    r"alertdialog|hidden)"
)
_NOISE = re.compile(rf"(?:^|\s){_NOISE_WORD}(?:[_-]+{_NOISE_WORD})*(?:$|\s)", re.I)
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*>?|<\?[^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S
)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
#: Numbers that name a page or a record; shorter ones tell the parts of a template apart.
_NUMBER = re.compile(r"\d{3,}")


@dataclass
class Branch:
    """An element with a path of its own in the style tree."""

    path: str
    tag: str
    kind: int  # 1 main, -1 noise, 0 undeclared
    above: int = 0
    marked: bool = False  # a mark of its own by class, id or role
    hidden: bool = False  # in noise by tag or attribute, which the style tree does not undo
    children: list[str] = field(default_factory=list)
    same: dict[str, int] = field(default_factory=dict)  # children by label


def page_parts(page: str) -> tuple[list[tuple[str, int, int]], list[Branch]]:
    """Text runs (text, branch, block) in page order, and the branches; tolerant of any input."""
    branches = [Branch("", "", 0)]
    stack = [0]
    runs: list[tuple[str, int, int]] = []
    block, at = 0, 0
    length = len(page)
    while at <= length:
        token = _TOKEN.search(page, at)
        end = token.start() if token else length
        if end > at:
            runs.append((page[at:end], stack[-1], block))
        if not token:
            break
        at = token.end()
        name = token[2]
        if not name:
            continue
        name = name.lower()
        if token[1]:
            for depth in range(len(stack) - 1, 0, -1):
                if branches[stack[depth]].tag == name:
                    del stack[depth:]
                    break
            block += name in BLOCK
            continue
        while len(stack) > 1 and name in CLOSES.get(branches[stack[-1]].tag, ()):
            stack.pop()
        block += name in BLOCK
        above = branches[stack[-1]]
        label, declared, marked, hidden = name, 0, False, name in NEVER
        if token[3]:
            values = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(token[3])}
            if values:
                marks = " ".join(values.get(k, "") for k in ("class", "id", "role"))
                hidden = hidden or "hidden" in values or values.get("aria-hidden") == "true"
                if values.get("role") == "main":
                    declared = 1
                else:
                    marked = name not in FRAME and bool(_NOISE.search(marks))
                label = f"{name}.{_NUMBER.sub('0', values.get('class') or values.get('id') or '').strip()}"
        if name in FRAME:
            label = name  # their classes tell pages apart
        if hidden or marked:
            declared = -1
        elif name in MAIN:
            declared = 1
        above.children.append(label)
        if name in VOID:
            continue
        hidden = hidden or above.hidden
        # the main part of a page undoes a mark by class around it
        main = not hidden and (name == "main" or declared > 0 and name not in MAIN)
        kind = 1 if main else -1 if above.kind < 0 or declared < 0 else declared or above.kind
        place = above.same[label] = above.same.get(label, -1) + 1
        branches.append(Branch(f"{above.path}/{label}:{place}", name, kind, stack[-1], marked and not hidden, hidden))
        stack.append(len(branches) - 1)
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = close.end() if close else length
            stack.pop()
    return runs, branches


def clean(parts: list[str]) -> str:
    """Character references decoded, white space as one space."""
    return " ".join(entities.unescape("".join(parts)).split())


def page_blocks(page: str) -> tuple[list[tuple[str, int]], list[Branch]]:
    """Blocks of text, each with the branch it starts in, and the branches."""
    runs, branches = page_parts(page)
    blocks: list[tuple[str, int]] = []
    held: list[str] = []
    owner, current = 0, -1
    for text, branch, block in [*runs, ("", 0, -2)]:
        if block != current:
            if held and (joined := clean(held)):
                blocks.append((joined, owner))
            held, current, owner = [], block, branch
        elif not held or not "".join(held).strip():
            owner = branch
        # a declared part inside a block is a block of its own
        if held and branches[branch].kind < 0 <= branches[owner].kind or held and branches[owner].kind < 0 <= branches[branch].kind:
            if joined := clean(held):
                blocks.append((joined, owner))
            held, owner = [], branch
        held.append(text)
    return blocks, branches


_FACT = T.StructType(
    [
        T.StructField("host", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("role", T.StringType()),
        T.StructField("kind", T.IntegerType()),
        T.StructField("value", T.LongType()),
    ]
)


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per page: of each path outside noise by tag how it is presented and what it holds; the path of
    the page itself is empty."""
    import xxhash

    digest = lambda text: xxhash.xxh3_64_intdigest(text.encode()) - (1 << 63)
    for batch in batches:
        rows: list[tuple[str, str, str, int, int]] = []
        for host, page in zip(column_of(batch, "host").to_pylist(), column_of(batch, "html").to_pylist()):
            blocks, branches = page_blocks(page or "")
            held: dict[int, list[str]] = {}
            for text, owner in blocks:
                if branches[owner].hidden:
                    continue
                # what is marked counts for its own branches only
                noise = branches[owner].kind < 0
                for k in _upwards(branches, owner):
                    if noise and branches[k].kind >= 0:
                        break
                    held.setdefault(k, []).append(text)
            if held:
                held.setdefault(0, [text for text, owner in blocks if not branches[owner].hidden])
            for k, b in enumerate(branches):
                if not b.hidden:
                    runs = [c for i, c in enumerate(b.children) if not i or b.children[i - 1] != c]
                    rows.append((host, b.path, "style", b.kind if b.marked else max(b.kind, 0), digest("/".join(runs))))
                    if k in held:
                        rows.append((host, b.path, "content", b.kind if b.marked else max(b.kind, 0), digest("\n".join(held[k]))))
        if rows:
            kinds = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=_FACT.names)


def _upwards(branches: list[Branch], k: int) -> Iterator[int]:
    """The branch and all above it, the page (0) last."""
    yield k
    while k:
        k = branches[k].above
        yield k


def branch_importance(pages: DataFrame, decay: float = 0.9) -> DataFrame:
    """``host, path, kind, pages, style, content, importance`` of every branch of every host that lies
    outside noise by tag; ``kind`` is -1 for those marked by class.

    The entropy of presentations and that of contents are each divided by the log of the number of
    pages, so that 1 means all differ and 0 all are alike. As in a style tree the presentation counts
    with weight 1 - ``decay`` and what is below with ``decay``; the content of a path includes all
    that is below it, which keeps every branch a row of its own and the tree out of any one task.

    Copies of a page tell nothing of its template: contents are measured relative to the variety of whole
    pages on the host, and ``pages`` is at most the number of equally frequent pages of that variety.
    """
    facts = pages.select("host", "html").mapInArrow(_facts, _FACT)
    values = facts.groupBy("host", "path", "role", "value").agg(F.count("*").alias("n"), F.max("kind").alias("kind"))
    n = F.col("n").cast("double")
    spread = values.groupBy("host", "path", "role").agg(
        F.sum("n").alias("pages"), F.sum(n * F.log(n)).alias("weighted"), F.max("kind").alias("kind")
    )
    most = F.log(F.col("pages").cast("double"))
    spread = spread.withColumn("entropy", F.greatest(most - F.col("weighted") / F.col("pages"), F.lit(0.0)))
    spread = stored(
        spread.withColumn("entropy_share", F.when(F.col("pages") > 1, F.col("entropy") / most).otherwise(1.0)),
        "style-tree",
    )
    whole = spread.where((F.col("path") == "") & (F.col("role") == "content")).select(
        "host", F.round(F.exp("entropy"), 6).alias("varied"), F.col("entropy_share").alias("whole")
    )
    of = lambda role: F.max(F.when(F.col("role") == role, F.col("entropy_share")))
    branches = (
        spread.groupBy("host", "path")
        .agg(
            F.max("kind").alias("kind"), F.max("pages").alias("pages"), of("style").alias("style"), of("content").alias("content")
        )
        .join(whole, "host", "left")
    )
    relative = F.when(F.col("whole") > 0, F.least(F.col("content") / F.col("whole"), F.lit(1.0)))
    return branches.select(
        "host",
        "path",
        "kind",
        F.least("pages", F.coalesce("varied", F.lit(1.0))).alias("pages"),
        "style",
        F.coalesce(relative, F.lit(1.0)).alias("content"),
    ).withColumn("importance", F.lit(1 - decay) * F.col("style") + F.lit(decay) * F.col("content"))


def main_text(
    pages: DataFrame, least_importance: float = 0.5, least_pages: int = 8
) -> DataFrame:
    """``page_id, url, text, n_chars``: the main text of every page.

    Blocks inside declared noise go; but a mark by class, id or role is overruled on hosts with
    ``least_pages`` different pages or more, where the branch varies in presentation and in content alike, each
    by ``least_importance``. Of the others, inside a declared main part (``article``, ``main``) or not, those
    in branches whose importance is below ``least_importance`` go on such hosts. A declared main part
    counts as ``least_pages`` pages more of
    importance 1.

    A null page counts as empty and gives an empty text; a null url is a host of its own. Repeated
    rows each give a row. Columns other than ``page_id, url, html`` are ignored.
    """
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    sited = pages.select("page_id", "url", "html", host.alias("host"))
    # a declared main part is a prior, worth so many pages of importance 1
    prior = F.when(F.col("kind") > 0, F.lit(float(least_pages))).otherwise(0.0)
    importance = (F.col("pages") * F.col("importance") + prior) / (F.col("pages") + prior)
    # what repeats on a host, so the list is as long as its template
    marked = F.col("kind") < 0
    varies = F.least("style", "content") >= least_importance
    cut = stored(
        branch_importance(sited)
        .where((F.col("path") != "") & (F.col("pages") >= least_pages))
        .where(F.when(marked, varies).otherwise(importance < least_importance))
        .groupBy("host")
        .agg(
            F.collect_list(F.when(~marked, F.col("path"))).alias("cut"),
            F.collect_list(F.when(marked, F.col("path"))).alias("spared"),
        ),
        "cut-branches",
    )
    schema = T.StructType(
        [
            pages.schema["page_id"],
            pages.schema["url"],
            T.StructField("text", T.StringType()),
            T.StructField("n_chars", T.LongType()),
        ]
    )

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            lists = (column_of(batch, c).to_pylist() for c in ("html", "cut", "spared"))
            for page, cut_paths, spared_paths in zip(*lists):
                blocks, branches = page_blocks(page or "")
                gone, spared = set(cut_paths or ()), set(spared_paths or ())
                kept = [text for text, owner in blocks if _stays(branches, owner, gone, spared)]
                texts.append(" ".join(kept))
            columns = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [column_of(batch, "page_id"), column_of(batch, "url"), *columns], names=schema.names
            )

    return sited.join(cut, "host", "left").select("page_id", "url", "html", "cut", "spared").mapInArrow(extract, schema)


def _stays(branches: list[Branch], owner: int, gone: set[str], spared: set[str]) -> bool:
    if branches[owner].hidden or branches[owner].kind < 0 and not spared:
        return False
    noise = branches[owner].kind < 0
    for k in _upwards(branches, owner):
        b = branches[k]
        noise = noise and b.kind < 0
        if b.path in gone or noise and b.marked and b.path not in spared:
            return False
    return True
