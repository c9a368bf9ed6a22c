"""URL filtering by rules and by the reputation of hosts.

Reputation is empirical Bayes over labelled page outcomes (1 good, 0 bad).  Beta
priors pass means down from all pages to suffixes, from a suffix to its
registered domains, and from a domain to its hosts; at each level the prior's
weight comes from the level's own overdispersion (beta-binomial moments).  A
host with few labels, or none, thus stays near its domain, a host with many is
judged by them.  A url is allowed if the lower posterior bound of its host's
share of good pages reaches ``min_good``.  Rules come before reputation: a list of
any length is a table, joined by the ends of host names, so that each host brings
its rules along, longest first.

Only DataFrame functions are used.  Hosts are joined to pages by host; a host
with a large share of all pages is left to the split of skewed joins.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import save

MIN_GOOD = 0.5
#: Standard deviations below the posterior mean.
BOUND = 1.645
#: Bounds of a prior's weight in pages.
LEAST_WEIGHT, MOST_WEIGHT = 1.0, 10_000.0
#: What stands for the suffix of hosts that are addresses; each of them is a domain of its own.
ADDRESS = "[address]"
#: Second labels under which names are registered.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")


@dataclass(frozen=True)
class Rule:
    """Holds for a host with all its subdomains, if the path begins with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The rules of the registered query.
RULES = (Rule("org", "/", "allow"), Rule("example.org", "/es/", "block"), Rule("example.org", "/en/1", "block"), Rule("com", "/fr/", "allow"), Rule("com", "/de/", "block"))


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def host_of(url: Column) -> Column:
    """From after ``://`` to the next ``/``, ``?``, ``#`` or the end; A-Z in lower case."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.regexp_extract(_rest(url), "^([^/?#]*)", 1), upper, upper.lower())


def path_of(url: Column) -> Column:
    """From the end of the host to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def suffix_of(host: Column) -> Column:
    """The last label, or the last two where names are registered under the second."""
    labels = F.split(_bare(host), "\\.")
    n = F.size(labels)
    second = (n >= 3) & F.element_at(labels, -2).isin(*SECOND_LEVEL) & (F.length(F.element_at(labels, -1)) == 2)
    return F.when(_is_address(host), ADDRESS).when(second, F.array_join(F.slice(labels, -2, 2), ".")).otherwise(F.element_at(labels, -1))


def domain_of(host: Column) -> Column:
    """The suffix and one label more; the host itself if it has no more."""
    labels = F.split(_bare(host), "\\.")
    n = F.size(F.split(suffix_of(host), "\\.")) + 1
    return F.when(_is_address(host) | (F.size(labels) <= n), _bare(host)).otherwise(F.array_join(F.slice(labels, -n, n), "."))


def _is_address(host: Column) -> Column:
    """Four numbers with dots between, or what stands in brackets."""
    return _bare(host).rlike("^([0-9]{1,3}[.]){3}[0-9]{1,3}$|^\\[.*\\]$")


def _bare(host: Column) -> Column:
    """Without user information and port."""
    return F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", "")


def rules_table(spark: SparkSession, rules: Sequence[Rule] | DataFrame) -> DataFrame:
    """``rule_host, rule_path, verdict`` of rules given as a list, or as a table with those columns."""
    if isinstance(rules, DataFrame):
        return rules.select("rule_host", "rule_path", "verdict")
    return spark.createDataFrame([(r.host, r.path, r.verdict) for r in rules], "rule_host string, rule_path string, verdict string")


def rules_of_hosts(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """``host, rules``: the rules whose host is that of ``hosts`` (distinct) or one above it, the longest first; hosts without any are left out."""
    rules = rules.where("rule_host IS NOT NULL AND rule_path IS NOT NULL").withColumn("text", F.concat("rule_host", "rule_path"))
    most = rules.agg(F.coalesce(F.max(F.size(F.split("rule_host", "\\."))), F.lit(0))).first()[0]
    # ends of a host of as many labels as rules have at most
    ends = hosts.select("host", F.explode(F.transform(F.sequence(F.lit(1), F.least(F.size(F.split("host", "\\.")), F.lit(max(1, most)))), lambda i: F.call_function("substring_index", "host", F.lit("."), -i))).alias("rule_host"))
    found = ends.join(rules, "rule_host")
    return found.groupBy("host").agg(F.sort_array(F.collect_list(F.struct(F.length("text").alias("length"), "text", "rule_path", "verdict")), asc=False).alias("rules"))


def _weight(groups: DataFrame) -> float:
    """The weight of a level's prior from ``good, n`` of its groups and the ``prior`` mean of each."""
    m, n = F.col("prior"), F.col("n")
    var = m * (1 - m)
    over, base = groups.where("n > 1").agg(F.sum((F.col("good") - n * m) ** 2 - n * var), F.sum(n * (n - 1) * var)).first()
    if not base or over <= 0:
        return MOST_WEIGHT
    return min(MOST_WEIGHT, max(LEAST_WEIGHT, base / over - 1))


def host_reputation(labelled: DataFrame) -> DataFrame:
    """``host, n, good, mean, lower`` from ``host, outcome``; a null outcome is an unlabelled page."""
    hosts = labelled.groupBy("host").agg(F.count("outcome").alias("n"), F.coalesce(F.sum("outcome"), F.lit(0)).cast("double").alias("good"))
    hosts = save(hosts.withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("host"))), "hosts")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    suffixes = hosts.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    n_all, good_all = hosts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("good"), F.lit(0.0))).first()
    overall = (good_all + 1) / (n_all + 2)

    def shrunk(groups: DataFrame) -> tuple[DataFrame, float]:
        weight = _weight(groups)
        return groups.withColumn("mean", (F.col("good") + weight * F.col("prior")) / (F.col("n") + weight)), weight

    suffixes, _ = shrunk(suffixes.withColumn("prior", F.lit(overall)))
    domains, _ = shrunk(domains.join(suffixes.select("suffix", F.col("mean").alias("prior")), "suffix"))
    hosts, weight = shrunk(hosts.join(domains.select("domain", F.col("mean").alias("prior")), "domain"))
    total = F.col("n") + weight
    return hosts.select("host", "n", "good", "mean", (F.col("mean") - BOUND * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (total + 1))).alias("lower"))


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: Sequence[Rule] | DataFrame = (), min_good: float = MIN_GOOD, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: ``page_id, host, path, rule, verdict, lower_bound``.

    ``outcomes`` has ``page_id, outcome`` (1 good, 0 bad) for some pages; null
    ids and outcomes there are not used, and of several the worst counts.  A url
    that is null or has no ``://`` has an empty host and path; such pages share
    the empty host's reputation.  Ids may be null or repeat; rows stay as many as
    they are.  Other columns are not read.  An empty table gives an empty result;
    without outcomes all hosts have the same bound.
    """
    own = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    known = outcomes.where("page_id IS NOT NULL AND outcome IS NOT NULL").groupBy("page_id").agg(F.min("outcome").alias("outcome"))
    reputation = host_reputation(own.select("page_id", "host").join(known, "page_id", "left").select("host", "outcome")).select("host", "lower")
    hosts = reputation.join(rules_of_hosts(reputation.select("host"), rules_table(pages.sparkSession, rules)), "host", "left")
    found = own.join(hosts, "host").withColumn("rule", F.get(F.filter("rules", lambda r: F.col("path").startswith(r["rule_path"])), F.lit(0)))
    own_verdict = F.when(F.col("lower") >= min_good, "allow").otherwise("block")
    return found.select("page_id", "host", "path", F.col("rule.text").alias("rule"), F.coalesce("rule.verdict", own_verdict).alias("verdict"), F.round("lower", 6).alias("lower_bound"))


def labelled_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``page_id, outcome`` of pages whose url names a labelled document: good means of quality and not toxic."""
    pages, labels = spark.read.parquet(f"{sf_dir}/pages.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    number = F.regexp_extract(path_of(F.col("url")), "/([0-9]{1,18})(/|$)", 1)
    named = pages.select("page_id", F.nullif(number, F.lit("")).cast("long").alias("doc_id"))
    good = labels.groupBy("doc_id").agg(F.min(F.when((F.col("quality") == 1) & (F.col("toxic") == 0), 1).otherwise(0)).alias("outcome"))
    return named.join(good, "doc_id").select("page_id", "outcome")


def op1_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url."""
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), labelled_pages(spark, sf_dir), RULES)


ORACLE = r"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
     p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
     good AS (SELECT doc_id, min(CASE WHEN quality = 1 AND toxic = 0 THEN 1 ELSE 0 END) AS outcome FROM labels GROUP BY doc_id),
     l AS (SELECT p.host, good.outcome FROM p LEFT JOIN good ON good.doc_id = TRY_CAST(nullif(regexp_extract(p.path, '/([0-9]{1,18})(/|$)', 1), '') AS BIGINT)),
     bare AS (SELECT *, string_split(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '.') AS labels FROM l),
     named AS (SELECT host, outcome, labels, len(labels) AS k,
                      regexp_matches(array_to_string(labels, '.'), '^([0-9]{1,3}[.]){3}[0-9]{1,3}$|^\[.*\]$') AS address,
                      CASE WHEN len(labels) >= 3 AND labels[-2] IN ('ac', 'co', 'com', 'edu', 'gov', 'net', 'org') AND length(labels[-1]) = 2 THEN 2 ELSE 1 END AS s FROM bare),
     hosts AS (SELECT host, count(outcome) AS n, CAST(coalesce(sum(outcome), 0) AS DOUBLE) AS good,
                      any_value(CASE WHEN address THEN '[address]' ELSE array_to_string(labels[-s:], '.') END) AS suffix, any_value(array_to_string(labels[-(CASE WHEN address THEN k ELSE least(s + 1, k) END):], '.')) AS domain FROM named GROUP BY host),
     overall AS (SELECT (sum(good) + 1) / (sum(n) + 2) AS m FROM hosts),
     sx AS (SELECT suffix, sum(n) AS n, sum(good) AS good, any_value(m) AS prior FROM hosts, overall GROUP BY suffix),
     sw AS (SELECT CASE WHEN coalesce(sum(n * (n - 1) * prior * (1 - prior)) FILTER (WHERE n > 1), 0) = 0 OR sum((good - n * prior) ** 2 - n * prior * (1 - prior)) FILTER (WHERE n > 1) <= 0 THEN 10000.0
                    ELSE least(10000.0, greatest(1.0, sum(n * (n - 1) * prior * (1 - prior)) FILTER (WHERE n > 1) / sum((good - n * prior) ** 2 - n * prior * (1 - prior)) FILTER (WHERE n > 1) - 1)) END AS w FROM sx),
     sm AS (SELECT suffix, (good + w * prior) / (n + w) AS mean FROM sx, sw),
     dx AS (SELECT domain, suffix, sum(n) AS n, sum(good) AS good, any_value(mean) AS prior FROM hosts JOIN sm USING (suffix) GROUP BY domain, suffix),
     dw AS (SELECT CASE WHEN coalesce(sum(n * (n - 1) * prior * (1 - prior)) FILTER (WHERE n > 1), 0) = 0 OR sum((good - n * prior) ** 2 - n * prior * (1 - prior)) FILTER (WHERE n > 1) <= 0 THEN 10000.0
                    ELSE least(10000.0, greatest(1.0, sum(n * (n - 1) * prior * (1 - prior)) FILTER (WHERE n > 1) / sum((good - n * prior) ** 2 - n * prior * (1 - prior)) FILTER (WHERE n > 1) - 1)) END AS w FROM dx),
     dm AS (SELECT domain, (good + w * prior) / (n + w) AS mean FROM dx, dw),
     hx AS (SELECT host, n, good, mean AS prior FROM hosts JOIN dm USING (domain)),
     hw AS (SELECT CASE WHEN coalesce(sum(n * (n - 1) * prior * (1 - prior)) FILTER (WHERE n > 1), 0) = 0 OR sum((good - n * prior) ** 2 - n * prior * (1 - prior)) FILTER (WHERE n > 1) <= 0 THEN 10000.0
                    ELSE least(10000.0, greatest(1.0, sum(n * (n - 1) * prior * (1 - prior)) FILTER (WHERE n > 1) / sum((good - n * prior) ** 2 - n * prior * (1 - prior)) FILTER (WHERE n > 1) - 1)) END AS w FROM hx),
     hm AS (SELECT host, n + w AS total, (good + w * prior) / (n + w) AS mean FROM hx, hw),
     hb AS (SELECT host, mean - 1.645 * sqrt(mean * (1 - mean) / (total + 1)) AS lower FROM hm),
     r AS (SELECT p.page_id, p.host, p.path, hb.lower,
                  CASE WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
                       WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
                       WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
                       WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
                       WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule
           FROM p JOIN hb USING (host))
SELECT page_id, host, path, rule,
       CASE rule WHEN 'org/' THEN 'allow' WHEN 'com/fr/' THEN 'allow' WHEN 'example.org/es/' THEN 'block' WHEN 'example.org/en/1' THEN 'block' WHEN 'com/de/' THEN 'block'
                 ELSE CASE WHEN lower >= 0.5 THEN 'allow' ELSE 'block' END END AS verdict, round(lower, 6) AS lower_bound
FROM r
"""
