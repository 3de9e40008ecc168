"""Main text of web pages by equivalence classes of template tokens.

1. Every page is read as tokens: its tags, each told apart by the containers around it. Tokens of a
   host whose counts agree on all its pages have the same occurrence vector; a hash of the
   vector is formed by sums, so that a host of any size needs one small row per token and task.
2. Tokens with one occurrence vector are an equivalence class (``classes``). A class is valid if its tokens
   stand once in a page and at least half of the host's pages have it. It nests in the slot of the
   innermost container around all its tokens that is not its own; valid classes whose slots belong to valid classes
   again, up to the outermost container, make up the template.
3. A slot is what a container holds besides nested containers. Text that never changes on a host is the template's
   own. The data region is a container of the template that holds the greater part of the words that
   change and are not links: the innermost one with the page's changing first-level heading, if any has it.
   What it holds is extracted, without the template's own text.

Names of elements only decide where occurrences cannot: between nested containers that all hold the greater part
(an ``article`` or ``main`` goes first), boilerplate that changes from page to page as the article
does (adverts, reader comments, menus of links), and pages without the data region.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from duoglot.llm.common import chunks

# Elements by their role in HTML.
CONTAINERS = frozenset("html head body nav header footer main article section aside form div ul ol menu "
                       "table figure fieldset dialog details".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp "
                   "small span strike strong sub sup time tt u var wbr".split())
BOILERPLATE = frozenset("head nav footer aside form menu dialog".split())
# Words in class, id or role that name boilerplate.
BOILERPLATE_WORDS = frozenset(
    "ad ads advert advertisement adverts alert banner breadcrumb breadcrumbs comment comments consent "
    "cookie cookies copyright disqus footer login masthead menu modal nav navbar navigation newsletter "
    "notice notices pager pagination popup promo promoted recommended related respond search share "
    "sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget".split())
MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|select|button|svg|iframe|object)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\s++|\"[^\"]*\"|'[^']*'|[^\s\"'>]++|[\"'])*+)>", re.S | re.I)
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
SMALLEST_SUPPORT, CONSTANT_PAGES, LINK_SHARE = 0.5, 3, 0.5
# A region holds more than half of the data's words; one without a telling name more than this.
REGION_SHARE, NAMELESS_SHARE = 0.5, 0.75
# A path names this many containers; deeper ones share the slot of the last of them, but for their own step.
PATH_STEPS = 48
BROADCAST_BYTES = 64 << 20


def read_page(page: str) -> tuple[dict[str, int], list[tuple[str, str, bool]]]:
    """Counts of tokens, and text runs ``(slot, text, linked)`` in page order.

    A slot is the path of open containers, such as ``html/body/div.ad``; a token is a slot or
    an inner tag at a slot. Unclosed inner tags do no harm: they open no slot. Text between inline tags stays joined;
    any other tag puts a space between.
    """
    counts: dict[str, int] = {}
    runs: list[tuple[str, str, bool]] = []
    path: list[str] = []
    names: list[str] = []
    slot, links, at = "", 0, 0

    def add(text: str) -> None:
        if text:
            runs.append((slot, text, links > 0))

    for found in MARKUP.finditer(page):
        add(html.unescape(page[at:found.start()]))
        at = found.end()
        closing, name, rest = found.group(2), found.group(3), found.group(4)
        if not name:
            continue
        name = name.lower()
        if name == "a":
            links = 0 if closing else 1
        if name not in INLINE:
            add(" ")
        if name not in CONTAINERS:
            if not closing:
                token = f"{slot}>{name}"
                counts[token] = counts.get(token, 0) + 1
        elif not closing:
            words = re.findall(r"[a-z0-9]+", " ".join(max(g) for g in NAMES.findall(rest)).lower())
            step = ".".join([name, *words])
            if len(path) < PATH_STEPS:
                outer = path[-1] if path else ""
            else:
                # Boilerplate among the steps left out is not forgotten.
                outer = path[-1] if len(path) == PATH_STEPS or is_boilerplate(path[-1]) else path[PATH_STEPS - 1]
                step = "" if outer.count("/") > PATH_STEPS else step
            path.append("/".join(filter(None, (outer, step))))
            names.append(name)
            slot, links = path[-1], 0
            counts[slot] = counts.get(slot, 0) + 1
        elif name in names:
            while names.pop() != name:
                path.pop()
            path.pop()
            slot, links = path[-1] if path else "", 0
    add(html.unescape(page[at:]))
    return counts, runs


def is_boilerplate(slot: str, inside: bool = False) -> bool:
    """Whether a step of the path names boilerplate; a header does unless it is ``inside`` the article."""
    for step in slot.split("/"):
        name, *words = step.split(".")
        if name in BOILERPLATE or BOILERPLATE_WORDS.intersection(words) or name == "header" and not inside:
            return True
        inside = inside or name in ("article", "main")
    return False


def named_and_headed(slot: str) -> tuple[bool, bool]:
    return is_boilerplate(slot), is_boilerplate(slot, inside=slot.count("/") > 2)


def in_article(slot: str) -> bool:
    return any(step.split(".")[0] in ("article", "main") for step in slot.split("/"))


def with_host(pages: DataFrame, url_col: str) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)", 1))
    return pages.withColumn("_host", host)


def occurrences(pages: DataFrame, html_col: str, url_col: str) -> DataFrame:
    """``(host, token, pages, once, vector, low, high, words, link_words, named, headed)``: what all pages of
    a host say about a token, by sums that tasks form before the shuffle. ``named`` says that its path names
    boilerplate, ``headed`` that it does so even where headers are part of the article."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = lru_cache(100_000)(named_and_headed)
        for part in chunks(batches, "html"):
            rows: list[tuple] = []
            for host, page in zip(part.column("host").to_pylist(), part.column("html").to_pylist()):
                counts, runs = read_page(page)
                name = xxhash.xxh3_64_intdigest(page.encode("utf-8", "surrogatepass"))
                text: dict[str, list] = {}
                for slot, run_, linked in runs:
                    own = text.setdefault(slot, ["", 0, 0])
                    n = len(run_.split())
                    own[0] += run_
                    own[1] += n
                    own[2] += n * linked
                for token, n in counts.items():
                    vector = xxhash.xxh3_64_intdigest(f"{name} {n}".encode()) - (1 << 63)
                    content, words, linked = text.get(token, ("", 0, 0))
                    rows.append((host, token, n == 1, vector, xxhash.xxh3_64_intdigest(
                        " ".join(content.split()).encode("utf-8", "surrogatepass")) - (1 << 63), words, linked,
                        *names(token.partition(">")[0])))
            kinds = [pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64(),
                     pa.bool_(), pa.bool_()]
            columns = list(zip(*rows)) if rows else [[]] * 9
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[
                "host", "token", "once", "vector", "content", "words", "link_words", "named", "headed"])

    source = with_host(pages, url_col).select(F.col("_host").alias("host"),
                                              F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    rows = source.mapInArrow(run, "host string, token string, once boolean, vector long, content long, "
                             "words long, link_words long, named boolean, headed boolean")
    # Wrapping sums would fail in ANSI mode, so the vector's hash is an exclusive or.
    return rows.groupBy("host", "token").agg(
        F.count("*").alias("pages"), F.min("once").alias("once"), F.bit_xor("vector").alias("vector"),
        F.min("content").alias("low"), F.max("content").alias("high"),
        F.sum("words").alias("words"), F.sum("link_words").alias("link_words"),
        F.bool_or("named").alias("named"), F.bool_or("headed").alias("headed"))


def _around(path: Column, steps: Column) -> Column:
    """The first steps of a path."""
    return F.array_join(F.slice(F.split(path, "/"), 1, steps), "/")


def supported(found: DataFrame, pages: DataFrame, url_col: str) -> DataFrame:
    """The tokens with ``support``, the share of the host's pages that have one, and its path and ``depth``."""
    sizes = with_host(pages, url_col).groupBy(F.col("_host").alias("host")).agg(F.count("*").alias("host_pages"))
    path = F.substring_index("token", ">", 1)
    return (found.join(sizes, "host").withColumn("support", F.col("pages") / F.col("host_pages"))
            .withColumn("path", path).withColumn("depth", F.size(F.split(path, "/"))))


def classes(tokens: DataFrame) -> DataFrame:
    """``(host, vector, pages, size, support, valid, slot)``, one row per equivalence class: tokens of one host
    with one occurrence vector (equal pages cancel in the hash, not in the count of pages). ``slot`` is the
    container the class nests in, empty for an outermost one."""
    # The first and last path in the order of their steps differ wherever any two of them do.
    steps = F.split("path", "/")
    found = tokens.groupBy("host", "vector", "pages").agg(
        F.count("*").alias("size"), F.min("support").alias("support"),
        (F.min("once") & (F.min("support") >= SMALLEST_SUPPORT)).alias("valid"),
        F.min(steps).alias("first"), F.max(steps).alias("last"),
        F.min(F.when(~F.col("token").contains(">"), F.col("depth"))).alias("outermost"))
    same = F.transform(F.col("first"), lambda x, i: (x == F.get("last", i)) & (i < F.size("last")))
    shared = F.coalesce(F.array_position(F.transform(same, lambda x: F.coalesce(x, F.lit(False))), False)
                        .cast("int"), F.lit(0))
    shared = F.when(shared == 0, F.size("first")).otherwise(shared - 1)
    # A container around all tokens may be one of the class: then the class nests in the one around it.
    inner = F.when(F.col("outermost") <= shared, F.col("outermost") - 1).otherwise(shared)
    return found.select("host", "vector", "pages", "size", "support", "valid",
                        F.array_join(F.slice("first", 1, inner), "/").alias("slot"))


def templates(found: DataFrame, pages: DataFrame, url_col: str) -> DataFrame:
    """``(host, region, template_text, dull)`` per host: the data region (null if no container holds the
    greater part of the text), the slots whose text is the template's own, and those of links."""
    tokens = supported(found, pages, url_col).checkpoint()
    valid = classes(tokens).where("valid").select("host", "vector", "pages")
    slots = tokens.where(~F.col("token").contains(">") & (F.col("words") > 0))
    constant = (F.col("pages") >= CONSTANT_PAGES) & (F.col("low") == F.col("high"))
    linked = F.col("link_words") > LINK_SHARE * F.col("words")
    slots = slots.withColumn("constant", constant).withColumn("linked", linked)
    # Where nothing changes (copies of one page), nothing tells template and data apart.
    changing = slots.where(~F.col("constant")).select("host").distinct().withColumn("varies", F.lit(True))
    slots = slots.join(changing, "host", "left").withColumn(
        "constant", F.col("constant") & F.coalesce("varies", F.lit(False)))

    data = slots.where(~F.col("constant") & ~F.col("linked"))
    plain = data.where(~F.col("named")).select("host", "path", "depth", "words")
    mass = (plain.select("host", "words", F.explode(F.transform(
                F.sequence(F.lit(1), F.col("depth")), lambda n: _around(F.col("path"), n))).alias("path"))
            .groupBy("host", "path").agg(F.sum("words").alias("mass")))
    total = plain.groupBy("host").agg(F.sum("words").alias("total"))
    # Containers of valid classes that hold the greater part: at most one per depth, each within the one before.
    holding = (tokens.where(~F.col("token").contains(">")).join(valid, ["host", "vector", "pages"])
               .join(mass, ["host", "path"]).join(total, "host")
               .where(F.col("mass") > REGION_SHARE * F.col("total")))
    chain = holding.withColumn("place", F.row_number().over(Window.partitionBy("host").orderBy("depth"))).where(
        F.col("place") == F.col("depth")).select(
            "host", "path", "depth", F.col("path").rlike(r"(^|/)(article|main)(\.[^/]*)?$").alias("telling"),
            (F.col("mass") > NAMELESS_SHARE * F.col("total")).alias("most"))
    # The slot of a heading is one that changes; a header is part of an article, not of the page's own frame.
    heads = (tokens.where(F.col("token").endswith(">h1") & F.col("once") & ~F.col("headed")
                          & (F.col("support") >= SMALLEST_SUPPORT)).select("host", "path")
             .join(data.select("host", "path"), ["host", "path"], "left_semi").withColumnRenamed("path", "head"))
    holds = F.col("head").isNotNull() & F.startswith(F.concat("head", F.lit("/")), F.concat("path", F.lit("/")))
    region = (chain.join(heads, "host", "left").groupBy("host", "path", "depth", "telling", "most")
              .agg(F.coalesce(F.bool_or(holds), F.lit(False)).alias("headed"))
              .groupBy("host").agg(F.max_by("path", F.struct("telling", "most", "headed", "depth")).alias("region")))
    # Slots that half of the pages have: at most twice as many as a page has on average.
    texts = (slots.where(F.col("support") >= SMALLEST_SUPPORT).groupBy("host").agg(
        F.collect_set(F.when(F.col("constant"), F.col("path"))).alias("template_text"),
        F.collect_set(F.when(F.col("linked"), F.col("path"))).alias("dull")))
    return texts.join(region, "host", "left").select("host", "region", "template_text", "dull")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
            broadcast_hosts: int = 100_000) -> DataFrame:
    """``(id, url, text, n_chars)``, one row per row of ``pages``.

    The data region's blocks (of a page without it: the named article's, otherwise all that are neither the
    template's text nor links) in page order, white space runs as one space, blocks joined by one space,
    character references decoded. Null or empty html gives an empty text. Pages without a host share
    one group. Repeated and null ids stay rows of their own; other columns are not read.
    """
    template = templates(occurrences(pages, html_col, url_col), pages, url_col).checkpoint()
    # One row per host. Up to a counted number and size they are broadcast; beyond it the pages are shuffled by host
    # and salted, so that a large host is spread over 64 tasks.
    source = with_host(pages, url_col).select(
        F.col(id_col).alias("id"), F.col(url_col).alias("url"), "_host",
        F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    size = template.agg(F.count("*").alias("n"), F.sum(F.octet_length(F.to_json(F.struct("*")))).alias("b")).first()
    if size["n"] <= broadcast_hosts and (size["b"] or 0) <= BROADCAST_BYTES:
        joined = source.join(F.broadcast(template), source["_host"] == template["host"], "left")
    else:
        salted = source.withColumn("salt", F.pmod(F.xxhash64("html"), F.lit(64)).cast("int"))
        spread = template.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(63))))
        joined = salted.join(spread, (salted["_host"] == spread["host"]) & (salted["salt"] == spread["salt"]), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = lru_cache(100_000)(is_boilerplate)
        for part in chunks(batches, "html"):
            texts = []
            for page, region, fixed, dull in zip(*(part.column(c).to_pylist() for c in (
                    "html", "region", "template_text", "dull"))):
                _, runs = read_page(page)
                fixed = frozenset(fixed or ())
                within = f"{region}/"
                if region and any(f"{slot}/".startswith(within) and text.strip() for slot, text, _ in runs):
                    article = region.count("/") > 1
                    out = {slot for slot, _, _ in runs if not f"{slot}/".startswith(within)
                           or slot in fixed or known(slot, article and not known(region, True))}
                else:
                    named = any(in_article(slot) for slot, _, _ in runs)
                    out = {slot for slot, _, _ in runs if known(slot)
                           or (not in_article(slot) if named else slot in fixed or slot in (dull or ()))}
                own = [" " if slot in out else text for slot, text, _ in runs]
                texts.append(" ".join("".join(own).split()))
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), part.column("url"), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], names=[id_col, "url", "text", "n_chars"])

    kind = pages.schema[id_col].dataType.simpleString()
    return (joined.select("id", "url", "html", "region", "template_text", "dull")
            .mapInArrow(run, f"{id_col} {kind}, url string, text string, n_chars long"))
