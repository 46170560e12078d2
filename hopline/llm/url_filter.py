"""URL rules whose block decisions reach redirect and canonical-link aliases."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopline.llm.common import let, let_all, lower_ascii
from hopline.llm.components import components


@dataclass(frozen=True)
class Rule:
    verdict: str  # "allow" or "block"
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    return let(
        url,
        lambda u: F.when(
            F.instr(u, "://") > 0, lower_ascii(F.regexp_extract(_after_scheme(u), r"^[^/?#]*", 0))
        ).otherwise(""),
    )


def path_of(url: Column) -> Column:
    return let(
        url,
        lambda u: F.when(
            F.instr(u, "://") > 0, F.regexp_extract(_after_scheme(u), r"^[^/?#]*([^?#]*)", 1)
        ).otherwise(""),
    )


def _after_scheme(url: Column) -> Column:
    return F.substring(url, F.instr(url, "://") + 3, F.length(url))


def key_of(url: Column) -> Column:
    """Host, path and query: what a redirect or canonical link leads to. Null without a host."""
    rest = F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^#]*)", 1)
    return let_all([host_of(url), rest], lambda host, rest: F.when(host != "", F.concat(host, rest)))


def longest_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, or null.

    Of rules of one length the alphabetically first wins, and allow before block.
    The rules are a parameter, tested longest first, without a join.
    """
    order = sorted(rules, key=lambda r: (-len(r.name), r.name, r.verdict != "allow"))

    def first(host: Column, path: Column) -> Column:
        found = F.when(F.lit(False), F.struct(F.lit("").alias("rule"), F.lit("").alias("verdict")))
        for rule in order:
            fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
            found = found.when(fits, F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.verdict).alias("verdict")))
        return found

    return let_all([host, path], first)


def _resolved(base: Column, target: Column) -> Column:
    """An absolute url for a link target, seen from the page at ``base``."""

    def build(target: Column, host: Column, path: Column, scheme: Column) -> Column:
        folder = F.regexp_extract(F.concat(host, path), r"^(.*/)", 1)
        folder = F.when(folder == "", F.concat(host, F.lit("/"))).otherwise(folder)
        return (
            F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target)
            .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
            .when(target.startswith("/"), F.concat(scheme, F.lit("://"), host, target))
            .when(target != "", F.concat(scheme, F.lit("://"), folder, target))
        )

    scheme = F.regexp_extract(base, r"^(.*?)://", 1)
    return let_all([target, host_of(base), path_of(base), scheme], build)


def link_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Edges ``(src, dst)`` of url keys from canonical links and meta refreshes.

    Comments and scripts are left out. Only pages with one of the two words are
    searched, and a page gives at most one edge of each kind.
    """
    base = F.col(url)
    marked = pages.select(base.alias("url"), F.col(html).alias("html")).filter(
        (host_of(F.col("url")) != "") & F.col("html").rlike("(?i)canonical|refresh")
    )
    clean = F.regexp_replace("html", r"(?is)<!--.*?-->|<script\b.*?</script>", "")
    tags = marked.select(
        "url",
        F.regexp_extract(clean, r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>", 0).alias("canonical"),
        F.regexp_extract(clean, r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>", 0).alias("refresh"),
    )
    targets = F.array(
        F.regexp_extract("canonical", r"(?is)\bhref\s*=\s*[\"']?\s*([^\"'\s>]+)", 1),
        F.regexp_extract("refresh", r"(?is)\burl\s*=\s*['\"]?\s*([^\"'\s>]+)", 1),
    )
    ends = tags.select("url", F.explode(targets).alias("target"))
    ends = ends.withColumn("target", F.regexp_replace("target", "&amp;", "&"))
    return ends.select(
        key_of(F.col("url")).alias("src"), key_of(_resolved(F.col("url"), F.col("target"))).alias("dst")
    ).filter("dst is not null and src <> dst")


def judge(
    pages: DataFrame,
    rules: list[Rule],
    redirects: DataFrame | None = None,
    url: str = "url",
    html: str = "html",
    keep: tuple[str, ...] = ("page_id",),
) -> DataFrame:
    """A verdict for every page: its own rule's, else that of the pages it is an alias of.

    Urls joined by redirects (``redirects``: url columns ``src``, ``dst``) or by
    the pages' own canonical links form components. In a component that a block
    rule hits and no allow rule does, pages without a rule are blocked; an
    explicit allow anywhere in it keeps such pages allowed. A rule that fits the
    page itself always decides.

    Every input row gives one row, repeated rows too. A null, empty or
    scheme-less url has an empty host and path, no rule and no aliases, and is
    allowed. Null html has no links. Other columns than ``keep`` are dropped.
    Components come from distributed star steps; no url list reaches the driver.
    """
    fits = lambda u: longest_rule(host_of(u), path_of(u), rules)
    edges = link_edges(pages, url, html)
    if redirects is not None:
        more = redirects.select(key_of(F.col("src")).alias("src"), key_of(F.col("dst")).alias("dst"))
        edges = edges.union(more.filter("src is not null and dst is not null"))
    member = components(edges, "src", "dst")
    own = fits(F.concat(F.lit("x://"), F.col("node")))["verdict"]
    says = member.groupBy("root").agg(
        F.max(own == "block").alias("some_block"), F.max(own == "allow").alias("some_allow")
    )
    blocked = says.filter("some_block and not coalesce(some_allow, false)").select("root")
    aliases = member.join(blocked, "root").select(F.col("node").alias("_key"))
    judged = pages.select(
        *(F.col(k) for k in keep),
        F.coalesce(F.col(url), F.lit("")).alias("_url"),
    ).select(
        *keep,
        host_of(F.col("_url")).alias("host"),
        path_of(F.col("_url")).alias("path"),
        fits(F.col("_url")).alias("_rule"),
        key_of(F.col("_url")).alias("_key"),
    )
    alias = judged.join(aliases.withColumn("_hit", F.lit(True)), "_key", "left")
    return alias.select(
        *keep,
        "host",
        "path",
        F.col("_rule.rule").alias("rule"),
        F.coalesce(F.col("_rule.verdict"), F.when(F.col("_hit"), "block"), F.lit("allow")).alias("verdict"),
    )
