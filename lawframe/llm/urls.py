"""URL filtering by given host rules and by mined association rules.

Tokens of a URL are its host suffixes (`h:example.org`), path segments (`p:en`) and query keys (`q:page`). FP-growth over
the labelled pages, whose bad ones carry the item LABEL, mines token combinations; those that imply LABEL with enough
support, and surely oftener than pages are bad at all (by `min_lift`, and by an interval that allows for the number of
combinations tried), and that no kept shorter combination already covers at no less confidence, become rules.
An inverted index keyed by each rule's rarest token finds the rules of a URL without trying them all. Given
allow/block rules use the same index, keyed by their host.

Edge cases: a null URL, or one without `://`, has an empty host and path, no tokens, and is allowed; null labels are left
out, a page with several labels is bad if one is; with no labels or no rules everything without a given rule is allowed;
repeated pages are judged each; URLs of any length are taken whole; only page_id and url are read, so other columns may have
any names.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lawframe.llm.common import schema_of, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)(?:\?([^#]*))?"
LABEL = "label=bad"
#: The chance of any rule at all where labels say nothing; it is divided among all combinations that are tried.
CHANCE = 0.001
#: (verdict, host, path): fits the host and its subdomains where the path starts so.
GIVEN = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, URL, 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def url_tokens(url: Column) -> Column:
    """array<string> of distinct tokens."""
    labels = F.split(host_of(url), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.lit("h:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    segments = F.transform(F.split(path_of(url), "/"), lambda s: F.concat(F.lit("p:"), s))
    keys = F.transform(F.split(F.coalesce(F.regexp_extract(url, URL, 3), F.lit("")), "&"), lambda s: F.concat(F.lit("q:"), F.substring_index(s, "=", 1)))
    return F.array_distinct(F.filter(F.concat(suffixes, segments, keys), lambda t: F.length(t) > 2))


def mine_rules(labelled: DataFrame, min_support: float, min_lift: float, chance: float = CHANCE) -> DataFrame:
    """Rows (url, bad) to rules (antecedent array<string>, confidence, support), pruned.

    All labelled rows count. `min_support` is the share of them that a rule and LABEL hold for; a rule's confidence is at
    least `min_lift` times the share of bad rows, and the lower end of its Wilson interval lies above that share. The
    interval is as wide as `chance`, divided by the number of combinations tried (all that occur with LABEL often
    enough), asks for: so that of thousands none is kept by luck. The number of rules is bounded by 1 / min_support and
    the number of tokens in a URL, not by the number of rows.
    """
    from statistics import NormalDist

    from pyspark.ml.fpm import FPGrowth

    items = labelled.select(F.concat(url_tokens(F.col("url")), F.when(F.col("bad"), F.array(F.lit(LABEL))).otherwise(F.array().cast("array<string>"))).alias("items"), F.col("bad").cast("int").alias("bad"))
    total, bad = items.agg(F.count("*"), F.coalesce(F.sum("bad"), F.lit(0))).first()
    base = bad / total if total else 1.0
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min(1.0, min_lift * base)).fit(items.select("items"))
    rules = model.associationRules.filter(F.col("consequent")[0] == LABEL).select(F.array_sort("antecedent").alias("antecedent"), "confidence", "support")
    tried = model.freqItemsets.filter(F.array_contains("items", LABEL)).count()
    sure = NormalDist().inv_cdf(1 - chance / max(1, tried))
    p, n, z2 = F.col("confidence"), F.col("support") * total / F.col("confidence"), sure * sure
    low = (p + z2 / (2 * n) - sure * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))) / (1 + z2 / n)
    rules = rules.filter(low > base)
    # a rule is redundant where one with fewer tokens fits wherever it does and is at least as sure
    a, b = rules.alias("a"), rules.select("antecedent", "confidence", F.explode("antecedent").alias("token")).alias("b")
    covered = (
        a.select("antecedent", "confidence", F.explode("antecedent").alias("token")).alias("x").join(b, "token")
        .filter((F.size("b.antecedent") < F.size("x.antecedent")) & (F.col("b.confidence") >= F.col("x.confidence")) & (F.size(F.array_except("b.antecedent", "x.antecedent")) == 0))
        .select(F.col("x.antecedent").alias("antecedent")).distinct()
    )
    return rules.join(covered, "antecedent", "left_anti")


def _index(rules: Iterable[tuple[list[str], float]]) -> dict[str, list[tuple[frozenset, float]]]:
    """Each rule under its rarest token."""
    rules = [(frozenset(tokens), confidence) for tokens, confidence in rules]
    uses: dict[str, int] = {}
    for tokens, _ in rules:
        for t in tokens:
            uses[t] = uses.get(t, 0) + 1
    found: dict[str, list] = {}
    for tokens, confidence in rules:
        found.setdefault(min(tokens, key=lambda t: (uses[t], t)), []).append((tokens, confidence))
    return found


def judge(pages: DataFrame, rules: DataFrame, given: list[tuple[str, str, str]], most_rules: int = 100_000) -> DataFrame:
    """pages (page_id, url) to (page_id, host, path, rule, verdict, confidence).

    With at most `most_rules` mined rules every task holds the index; beyond that URL tokens join the rules' index.
    """
    url = F.col("url")
    parsed = pages.select("page_id", "url", host_of(url).alias("host"), path_of(url).alias("path"), url_tokens(url).alias("tokens"))
    if rules.limit(most_rules + 1).count() <= most_rules:
        held = [(list(r["antecedent"]), float(r["confidence"])) for r in rules.select("antecedent", "confidence").collect()]
        return _judge_by_map(parsed, held, given)
    distinct = parsed.select("url", "tokens").distinct()
    uses = rules.select(F.explode("antecedent").alias("token")).groupBy("token").count()
    keyed = (
        rules.withColumn("token", F.explode("antecedent")).join(uses, "token")
        .groupBy("antecedent", "confidence").agg(F.min_by("token", F.struct("count", "token")).alias("token"))
    )
    hits = (
        distinct.withColumn("token", F.explode("tokens")).join(keyed, "token")
        .filter(F.size(F.array_except("antecedent", "tokens")) == 0)
        .groupBy("url").agg(F.max("confidence").alias("confidence"))
    )
    allowed = _judge_by_map(parsed, [], given).drop("confidence")
    joined = allowed.join(hits, "url", "left")
    return joined.withColumn("verdict", F.when(F.col("rule").isNull() & F.col("confidence").isNotNull(), "block").otherwise(F.col("verdict")))


def _judge_by_map(parsed: DataFrame, rules: list, given: list[tuple[str, str, str]]) -> DataFrame:
    schema = schema_of(parsed, ["page_id", "url"], "host string, path string, rule string, verdict string, confidence double")

    def scan(batches):
        import pyarrow as pa

        mined, hosts = _index(rules), {}
        for verdict, host, path in given:
            hosts.setdefault("h:" + host, []).append((path, host + path, verdict))
        for batch in batches:
            rows = []
            for path, tokens in zip(batch.column("path").to_pylist(), batch.column("tokens").to_pylist(), strict=True):
                fits = [(len(rule), rule, verdict) for t in tokens for start, rule, verdict in hosts.get(t, ()) if path.startswith(start)]
                own = set(tokens)
                sure = max((c for t in tokens for needs, c in mined.get(t, ()) if needs <= own), default=None)
                _, rule, verdict = max(fits, default=(0, None, "allow" if sure is None else "block"))
                rows.append((rule, verdict, sure))
            made = zip(*rows, strict=True) if rows else ((), (), ())
            made = [pa.array(x, t) for x, t in zip(made, (pa.string(), pa.string(), pa.float64()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("page_id", "url", "host", "path")] + made, schema.names)

    return parsed.mapInArrow(scan, schema)


def labelled_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(url, bad): pages whose number is a labelled document's; bad is low quality or toxic."""
    bad = labels.filter("doc_id is not null and (quality is not null or toxic is not null)").groupBy("doc_id").agg(F.max(F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("bad"))
    return pages.select(F.col("page_id").alias("doc_id"), "url").join(bad, "doc_id").select("url", "bad")


def op9_urls(spark, sf_dir: str, min_support: float = 0.005, min_lift: float = 1.2) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    rules = mine_rules(labelled_pages(pages, table(spark, sf_dir, "labels")), min_support, min_lift)
    return judge(pages, rules, GIVEN).select("page_id", "host", "path", "rule", "verdict", "confidence")
