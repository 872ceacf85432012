"""HTML extraction by wrapper induction.

Pages of one host share a template. Every page shows its tree as paths, siblings of one kind as one
node, with digests of what the nodes say; Spark counts them per host over all pages. Texts that most
pages with a path have there become template, paths whose text varies become slots, and the slot
that holds the article is the host's content. Each page is then aligned with its host's wrapper by
simple tree matching and the text of its content is kept, without the template inside it. The tags
article and main bound the slot; by themselves they decide only where pages give no wrapper.
Elements that HTML itself or their names mark as menus, notices, forms and the like are left out
everywhere.

Wrappers go to the tasks by broadcast while all of them have at most `BROADCAST_BYTES`, else by a
join on the host, whose large hosts adaptive execution splits.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.frames import staged
from tidemark.llm.words import slices

# A text is template on a path if so many pages have it there, and such a share of those that have the path.
TEMPLATE_PAGES, TEMPLATE_SHARE = 3, 0.5
BROADCAST_BYTES = 32 << 20
CONTENT_SHARE = 0.6
# Element names of HTML and names that sites give to parts that are not the article.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp noscript iframe noembed noframes".split())
BLOCK = set(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr"
    " html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
NOISE = set(
    "script style noscript template iframe object svg canvas math head title nav footer aside form button select option textarea input dialog menu"
    " audio video xmp noembed noframes".split()
)
NOISE_ROLES = set("navigation banner contentinfo complementary search dialog alert form menu menubar".split())
NOISE_NAMES = re.compile(
    r"(?:^|[-_ ])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|sidebar|side|menu\w*|nav|navbar|navigation|breadcrumbs?|footer|site-?header|masthead|cookies?|consent|gdpr"
    r"|notices?|alert|banner|popup|modal|overlay|newsletter|subscri\w*|signup|login|share|sharing|social|related|recommend\w*|comments?|replies|respond|disqus|widget|toolbar|pagination|pager|skip)(?:$|[-_ ])"
)
CLOSES = {
    "p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "option": {"option"},
}
BOUNDARY = set("article aside blockquote body details div dl fieldset figure footer form header html li main nav ol section table td th ul".split())

_TAG_STOP, _NAME_STOP, _CLOSE, _COMMENT_END = re.compile(r"[>\"']"), re.compile(r"[\s/>]"), re.compile(">"), re.compile("--!?>")
_NAME = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW}
_BLANKS = re.compile(r"\s+")


# sequences of block digests are told apart by a polynomial over this field
_PRIME, _BASE = (1 << 61) - 1, 0x1C6EF372FE94F82B % ((1 << 61) - 1)


class Node:
    """An element; `said` is the digest of the blocks it says (None for none), `chars` their length as lines."""

    __slots__ = ("tag", "name", "noise", "children", "said", "chars")

    def __init__(self, tag: str, name: str = "", noise: bool = False):
        self.tag, self.name, self.noise, self.children, self.said, self.chars = tag, name, noise, [], None, 0


def _element(tag: str, attributes: str) -> Node:
    name, noise = "", tag in NOISE
    if attributes:
        found = {m[1].lower(): (m[2] or m[3] or m[4] or "").lower() for m in _NAME.finditer(attributes)}
        name = " ".join(sorted(found.get("class", "").split()))
        if tag not in ("html", "body", "article", "main"):
            noise |= "hidden" in found or found.get("aria-hidden") == "true" or found.get("role", "") in NOISE_ROLES
            noise |= any(NOISE_NAMES.search(found[k]) is not None for k in ("class", "id") if k in found)
        elif tag == "article" and re.search(r"\b(comment|reply)", name):
            noise = True
    return Node(tag, name, noise)


class _Ends:
    """Where tags of a page end, asked from left to right; what was searched in vain is not searched again."""

    def __init__(self, html: str):
        self.html, self.near, self.open = html, {}, set()

    def next(self, pattern: re.Pattern, at: int) -> int:
        """Place of the next match from `at` on, the page's length if there is none."""
        low, high = self.near.get(pattern, (0, -1))
        if not low <= at <= high:
            m = pattern.search(self.html, at)
            high = m.start() if m else len(self.html)
            self.near[pattern] = (at, high)
        return high

    def tag(self, at: int) -> int:
        """Place after the tag whose attributes begin at `at`; 0 if it has no end outside of quotes."""
        html, spot, passed = self.html, self.next(_TAG_STOP, at), []
        while spot < len(html) and spot not in self.open:
            if html[spot] == ">":
                return spot + 1
            passed.append(spot)
            close = html.find(html[spot], spot + 1)
            if close < 0:
                break
            m = _TAG_STOP.search(html, close + 1)
            spot = m.start() if m else len(html)
        self.open.update(passed)
        return 0


def parse(html: str) -> Node:
    """A tree of elements and strings. Takes what browsers take: open and stray tags, bare text, cut ends."""
    root, ends, size = Node("#root"), _Ends(html), len(html)
    stack, open_ = [root], Counter()
    at, look = 0, html.find("<")

    def leave(k: int) -> None:
        open_.subtract(n.tag for n in stack[k:])
        del stack[k:]

    while look >= 0:
        sign, begin = html[look + 1 : look + 2], look + 2 if html.startswith("</", look) else look + 1
        tag, stop = "", 0
        if html.startswith("<!--", look):
            empty = html.startswith((">", "->"), look + 4)
            m = (_CLOSE if empty else _COMMENT_END).search(html, look + 4)
            stop = m.end() if m else size
        elif sign in ("!", "?"):
            stop = ends.next(_CLOSE, look + 2) + 1
            stop = stop if stop <= size else 0
        elif html[begin : begin + 1].isascii() and html[begin : begin + 1].isalpha():
            named = ends.next(_NAME_STOP, begin)
            stop = ends.tag(named)
            tag = html[begin:named].lower() if stop else ""
        if not stop:
            look = html.find("<", look + 1)
            continue
        if look > at:
            stack[-1].children.append(html[at:look])
        at = stop
        if tag and sign == "/":
            if tag == "br":
                stack[-1].children.append(Node("br"))
            for k in range(len(stack) - 1, 0, -1) if open_[tag] else ():
                if stack[k].tag == tag:
                    leave(k)
                    break
                if stack[k].tag in BOUNDARY and tag not in BOUNDARY:
                    break
        elif tag:
            attributes = html[named : stop - 1]
            node = _element(tag, attributes)
            shut = CLOSES.get(tag, {"p"} if tag in BLOCK else ())
            for k in range(len(stack) - 1, 0, -1) if any(open_[t] for t in shut) else ():
                if stack[k].tag in shut:
                    leave(k)
                    shut = shut if tag in ("tr", "tbody", "td", "th") else ()
                elif stack[k].tag in BOUNDARY and stack[k].tag not in shut:
                    break
            stack[-1].children.append(node)
            if tag in RAW:
                end = _RAW_END[tag].search(html, at)
                stop = end.start() if end else size
                node.children.append(html[at:stop])
                at = size if not end else html.find(">", end.end()) + 1 or size
            elif tag not in VOID and not attributes.rstrip().endswith("/") or tag in BOUNDARY:
                stack.append(node)
                open_[tag] += 1
        look = html.find("<", at)
    if at < size:
        stack[-1].children.append(html[at:])
    return root


def _block(run: list[str]) -> str:
    return _BLANKS.sub(" ", entities.unescape("".join(run))).strip() if run else ""


def measured(tree: Node) -> Node:
    """The tree with `said` and `chars` of every block, all found in one walk: a block's digest follows from those below it."""
    run, sums = [], []

    def add(said: int, count: int, chars: int) -> None:
        top = sums[-1]
        top[:] = (top[0] * pow(_BASE, count, _PRIME) + said) % _PRIME, top[1] + count, top[2] + chars

    def end() -> None:
        if text := _block(run):
            add(digest(text) % _PRIME, 1, len(text))
        run.clear()

    todo: list = [(tree, False)]
    while todo:
        node, done = todo.pop()
        if done:
            end()
            said, count, chars = sums.pop()
            if count:
                node.said, node.chars = said, chars + count - 1
                if sums:
                    add(said, count, chars)
        elif isinstance(node, str):
            run.append(node)
        elif node.tag == "br":
            run.append(" ")
        elif node.noise:
            end()
        else:
            if node.tag in BLOCK or node is tree:
                if sums:
                    end()
                sums.append([0, 0, 0])
                todo.append((node, True))
            todo.extend((c, False) for c in reversed(node.children))
    return tree


def blocks_of(nodes: list[Node | str], dropped: frozenset[int] = frozenset()) -> list[str]:
    """Texts of the blocks below the nodes, in order, without noise and dropped nodes."""
    out, run = [], []

    def end() -> None:
        if text := _block(run):
            out.append(text)
        run.clear()

    todo: list = list(reversed(nodes))
    while todo:
        node = todo.pop()
        if node is None:
            end()
        elif isinstance(node, str):
            run.append(node)
        elif node.tag == "br":
            run.append(" ")
        elif not node.noise and id(node) not in dropped:
            if node.tag in BLOCK:
                end()
                todo.append(None)
            todo.extend(reversed(node.children))
        elif node.tag in BLOCK or node.noise:
            end()
    end()
    return out


class Kind:
    """Neighbouring siblings of one tag and name, as one node of the tree that is aligned."""

    __slots__ = ("sign", "nodes", "below")

    def __init__(self, sign: str):
        self.sign, self.nodes, self.below = sign, [], []

    @property
    def chars(self) -> int:
        said = [n.chars for n in self.nodes if n.chars]
        return sum(said) + max(len(said) - 1, 0)


def kinds(tree: Node) -> list[Kind]:
    """Kinds below the root of a tree, each with those below it."""

    def level(children) -> list[Kind]:
        found: dict[str, Kind] = {}
        for c in children:
            if isinstance(c, Node) and not c.noise and c.tag in BLOCK:
                sign = f"{c.tag}.{c.name}"
                found.setdefault(sign, Kind(sign)).nodes.append(c)
        return list(found.values())

    top = level(tree.children)
    todo = list(top)
    while todo:
        kind = todo.pop()
        if kind.nodes[0].tag in BOUNDARY:
            kind.below = level(c for n in kind.nodes for c in n.children)
            todo += kind.below
    return top


def _rising(weighed: list[tuple[int, int]]) -> tuple[int, list[int]]:
    """The heaviest sequence of rising places among (place, weight): its weight, and which they are."""
    places, ends, before, total = [], [], [], []
    for n, (place, weight) in enumerate(weighed):
        i = bisect_left(places, place)
        before.append(ends[i - 1] if i else -1)
        total.append(weight + (total[ends[i - 1]] if i else 0))
        over = i
        while over < len(ends) and total[ends[over]] <= total[n]:
            over += 1
        places[i:over], ends[i:over] = [place], [n]
    chosen, n = [], ends[-1] if ends else -1
    while n >= 0:
        chosen.append(n)
        n = before[n]
    return total[ends[-1]] if ends else 0, chosen[::-1]


def matched(template: list[dict], own: list[Kind]) -> list[tuple[dict, Kind]]:
    """Simple tree matching of a wrapper and a page: the most nodes that pair up in order, parents with parents.

    Siblings differ in sign, so a node has one partner at most among those below its parent's, and the best
    pairing of a level is its heaviest rising sequence of places, weighed by what pairs up below.
    """

    def level(a: list[dict], b: list[Kind]) -> list[tuple]:
        at = {k.sign: (j, k) for j, k in enumerate(b)} if a else {}
        return [(t, *at[t["sign"]]) for t in a if t["sign"] in at]

    levels, heaviest, inner = [level(template, own)], {}, {}
    for n, pairs in enumerate(levels):  # grows meanwhile
        for i, (t, _, k) in enumerate(pairs):
            if below := level(t["below"], k.below):
                inner[n, i] = len(levels)
                levels.append(below)
    for n in range(len(levels) - 1, -1, -1):
        weights = [1 + (heaviest[inner[n, i]][0] if (n, i) in inner else 0) for i in range(len(levels[n]))]
        heaviest[n] = _rising([(j, w) for (_, j, _), w in zip(levels[n], weights, strict=True)])
    out, todo = [], [0]
    while todo:
        n = todo.pop()
        for i in heaviest[n][1]:
            t, _, k = levels[n][i]
            out.append((t, k))
            if (n, i) in inner:
                todo.append(inner[n, i])
    return out


def digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def path_below(above: str, sign: str) -> str:
    """A path's name: a digest, so that deep pages do not repeat all that is above a node."""
    return hashlib.blake2b(f"{above}\n{sign}".encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


def paths_of(html: str) -> tuple[int, list[dict]]:
    """Digest of all that a page says, and its kinds: path, path above, depth, sign, place among its siblings, digests and lengths of what the nodes say."""
    tree, out = measured(parse(html)), []
    todo = [("", 0, i, k) for i, k in enumerate(kinds(tree))]
    while todo:
        above, depth, place, kind = todo.pop()
        path = path_below(above, kind.sign)
        said = {n.said: n.chars for n in kind.nodes if n.said is not None}
        texts = [{"text": d, "chars": said[d]} for d in sorted(said)]
        out.append({"path": path, "above": above, "depth": depth, "sign": kind.sign, "place": place, "texts": texts})
        todo += [(path, depth + 1, i, k) for i, k in enumerate(kind.below)]
    return tree.said or 0, sorted(out, key=lambda x: x["path"])


def induce(paths: list[dict]) -> list[dict]:
    """The wrapper of a host from its paths (path, above, depth, sign, place, chars, texts): nodes with sign, template texts, content flag and the number of the one above.

    `chars` is the length of what varies there. Nodes that tell a page nothing are left out.
    """
    top: list[dict] = []
    known: dict[str, dict] = {}
    for row in sorted(paths, key=lambda r: (r["depth"], r["place"], r["sign"], r["path"])):
        known[row["path"]] = node = {**row, "texts": sorted(row["texts"]), "varies": row["chars"] > 0, "below": []}
        (known[row["above"]]["below"] if row["above"] else top).append(node)
    content = {id(t) for t in _content(top)}
    told: set[str] = set()
    for path, t in reversed(known.items()):
        if t["texts"] or id(t) in content or path in told:
            told |= {path, t["above"]}
    out, number = [], {"": -1}
    for path, t in known.items():
        if path in told:
            number[path] = len(out)
            out.append({"sign": t["sign"], "texts": t["texts"], "content": id(t) in content, "up": number[t["above"]]})
    return out


def unfolded(flat: list[dict]) -> list[dict]:
    """The nodes of a wrapper below each other."""
    nodes = [{"sign": t["sign"], "texts": frozenset(t["texts"]), "content": t["content"], "below": []} for t in flat]
    top = []
    for node, t in zip(nodes, flat, strict=True):
        (nodes[t["up"]]["below"] if t["up"] >= 0 else top).append(node)
    return top


def alone(own: list[Kind]) -> list[dict]:
    """The wrapper of a page that has no other to be compared with."""
    top: list[dict] = []
    todo = [(own, top)]
    while todo:
        level, into = todo.pop()
        for k in level:
            into.append({"sign": k.sign, "texts": frozenset(), "chars": k.chars, "varies": k.chars > 0, "content": False, "below": []})
            todo.append((k.below, into[-1]["below"]))
    for t in _marked(top) or _content(top):
        t["content"] = True
    return top


def _marked(template: list[dict], tags: tuple[str, ...] = ("article", "main")) -> list[dict]:
    """The outermost nodes that HTML marks as the article, else as the main part."""
    for tag in tags:
        found, todo = [], list(reversed(template))
        while todo:
            t = todo.pop()
            if t["sign"].startswith(f"{tag}."):
                found.append(t)
            else:
                todo.extend(reversed(t["below"]))
        if found:
            return found
    return []


def _content(template: list[dict]) -> list[dict]:
    """The innermost node that still holds most of the text that varies, an article or main part at most.

    Where no node below holds most of it, what HTML marks there is the content.
    """
    node, level = None, template
    while True:
        if node and node["sign"].startswith(("article.", "main.")):
            return _marked(level, ("article",)) or [node]
        varying = [t for t in level if t["varies"]]
        most = max(varying, key=lambda t: t["chars"], default=None)
        if most is None or not most["below"] and not most["sign"].startswith(("article.", "main.")) or most["chars"] < CONTENT_SHARE * sum(t["chars"] for t in varying):
            return _marked(level) or ([node] if node else [])
        node, level = most, most["below"]


def _first(nodes: list, tags: tuple[str, ...]) -> list[Node]:
    found, todo = [], [n for n in reversed(nodes) if isinstance(n, Node)]
    while todo:
        node = todo.pop()
        if node.noise:
            continue
        if node.tag in tags:
            found.append(node)
        else:
            todo.extend(c for c in reversed(node.children) if isinstance(c, Node))
    return found


def extract(html: str | None, wrapper: list[dict] | None) -> str:
    """The article's blocks without template, one line each. Empty for null, empty and wordless pages.

    A page that has nothing of its host's content slot falls back on what HTML marks as article or
    main part, then on all of the page; template goes from each of them.
    """
    if not html:
        return ""
    tree = measured(parse(html))
    dropped, slots, own = set(), [], kinds(tree)
    # a host whose pages share nothing has an empty wrapper, which is one
    wrapper = alone(own) if wrapper is None else wrapper
    for t, k in matched(wrapper, own):
        if t["content"]:
            slots += k.nodes
    # template is known by path and text, so it goes also where a page has its siblings in another order
    todo = [(wrapper, own)]
    while todo:
        nodes, level = todo.pop()
        known = {t["sign"]: t for t in nodes}
        for k in level:
            if t := known.get(k.sign):
                if t["texts"]:
                    dropped.update(id(n) for n in k.nodes if n.said in t["texts"])
                if t["below"]:
                    todo.append((t["below"], k.below))
    left = frozenset(dropped)
    for nodes in (slots, _first(tree.children, ("article",)), _first(tree.children, ("main",))):
        if nodes and (text := blocks_of(nodes, left)):
            return "\n".join(text)
    return "\n".join(blocks_of(tree.children, left))


def host_of(url: str):
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def _counted(pages: DataFrame) -> DataFrame:
    """(host, path, above, depth, sign, text, n, chars, place): pages of different content that have a text on a path, and with a null text those that have the path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = pa.list_(pa.struct([("text", pa.int64()), ("chars", pa.int64())]))
        names = [("path", pa.string()), ("above", pa.string()), ("depth", pa.int32()), ("sign", pa.string()), ("place", pa.int32()), ("texts", texts)]
        kind = pa.list_(pa.struct(names))
        for batch in slices(batches, "html"):
            shown = [paths_of(html) for html in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("host"), pa.array([x for x, _ in shown], pa.int64()), pa.array([x for _, x in shown], kind)], names=["host", "said", "paths"]
            )

    rows = pages.select(host_of("url").alias("host"), "html").where(F.length("html") > 0)
    shown = rows.mapInArrow(run, "host string, said long, paths array<struct<path:string,above:string,depth:int,sign:string,place:int,texts:array<struct<text:bigint,chars:bigint>>>>")
    # of pages that say the same in full one counts
    shown = shown.groupBy("host", "said").agg(F.min("paths").alias("paths")).select("host", F.explode("paths").alias("p"))
    whole = F.struct(F.lit(None).cast("long").alias("text"), F.aggregate("p.texts", F.lit(0).cast("long"), lambda n, t: n + t["chars"]).alias("chars"))
    each = shown.select("host", "p.path", "p.above", "p.depth", "p.sign", "p.place", F.explode(F.concat(F.array(whole), "p.texts")).alias("t"))
    return each.groupBy("host", "path", "above", "depth", "sign", F.col("t.text").alias("text")).agg(F.count("*").alias("n"), F.sum("t.chars").alias("chars"), F.avg("place").alias("place"))


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper as JSON) of each host that has pages of different content, from all of its pages.

    Paths and texts of a single page are nothing that pages share, so they are not kept.
    """
    counted = staged(_counted(pages).where("n > 1"), "page-paths")
    paths = counted.where("text is null").select("host", "path", "above", "depth", "sign", F.col("n").alias("_met"), F.col("chars").alias("_all"), "place")
    texts = counted.where("text is not null").select("host", "path", "text", "n", "chars").join(paths.select("host", "path", "_met"), ["host", "path"])
    texts = texts.where(F.col("n") >= TEMPLATE_SHARE * F.col("_met")).groupBy("host", "path").agg(
        F.sum("chars").alias("_fixed"), F.sort_array(F.collect_list(F.when(F.col("n") >= TEMPLATE_PAGES, F.col("text")))).alias("texts")
    )
    found = paths.join(texts, ["host", "path"], "left")
    chars, none = F.col("_all") - F.coalesce("_fixed", F.lit(0)), F.array().cast("array<bigint>")
    found = found.select("host", "path", "above", "depth", "sign", "place", chars.alias("chars"), F.coalesce("texts", none).alias("texts"))

    def learn_host(batch: pa.Table) -> pa.Table:
        wrapper = json.dumps(induce(batch.drop_columns("host").to_pylist()), ensure_ascii=False)
        return pa.table({"host": [batch.column("host")[0].as_py()], "wrapper": [wrapper]})

    return found.groupBy("host").applyInArrow(learn_host, "host string, wrapper string")


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of each row of `pages` (page_id, url, html).

    A null or empty html gives an empty text; a null url is a host of its own; repeated rows and
    null ids give a row each; other columns are ignored.
    """
    known = staged(wrappers(pages), "wrappers")
    size = known.agg(F.coalesce(F.sum(F.length("host") + F.length("wrapper")), F.lit(0))).first()[0]
    known = F.broadcast(known) if size <= BROADCAST_BYTES else known
    rows = pages.select("page_id", "url", "html", host_of("url").alias("host")).join(known, "host", "left").select("page_id", "url", "html", "wrapper")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read: dict[str | None, list[dict] | None] = {None: None}
        for batch in slices(batches, "html"):
            texts = []
            for html, wrapper in zip(batch.column("html").to_pylist(), batch.column("wrapper").to_pylist(), strict=True):
                if wrapper not in read:
                    if len(read) > 1000:
                        read = {None: None}
                    read[wrapper] = unfolded(json.loads(wrapper))
                texts.append(extract(html, read[wrapper]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    ids = pages.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"page_id {ids}, url string, text string, n_chars long")
