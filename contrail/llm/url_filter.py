"""URL filters: a path-template tree per host, judged by the smoothed purity of its labels.

Host and path are cut from the url by plain string functions. Rules (host, path prefix, verdict) come first: a
rule fits its host and all its subdomains if the path starts with the rule's; the longest fitting rule wins.

For the rest, each host has a tree of path segments, built level by level over counts, never over pages:

1. **Generalise.** A segment of digits becomes ``{n}`` (with its extension, if any), dates ``{date}``, UUIDs ``{uuid}``
   and long hexadecimal names ``{hex}``; at the others, a node with more than ``MAX_CHILDREN`` children turns those seen
   fewer than ``MIN_SUPPORT`` times into ``*``.
2. **Merge.** Under one parent, a branch whose share of bad labels does not differ from that of its siblings
   together (two-proportion z below ``MERGE_Z``) joins ``*``; what is left apart differs significantly.
3. **Reject.** A template is blocked if its share of bad labels, smoothed, is at least ``PURITY``. Smoothing adds
   ``PRIOR_WEIGHT`` labels at the share of its host, which is smoothed by that of the domain above it in the same way, and
   so on up to the corpus's share (``PURITY`` / 2 at most): a sparse host is judged by the hosts beside it. A template
   without a label of its own needs twice the ``PURITY``.

The tree goes down to the last segment of every path; what lies beyond ``DEPTH`` and never parts is written ``**``. Every level is a sum by (host, template, segment), combined within tasks
first, so that a host with a third of all pages costs a few rows.

Defined results: a null url, or one without ``://``, has an empty host and path and is allowed unless its template
says otherwise; unlabelled templates are judged by their host's share; repeated rows get equal verdicts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

DEPTH, MAX_CHILDREN, MIN_SUPPORT = 4, 20, 20
MERGE_Z, PRIOR_WEIGHT, PURITY = 1.64, 4.0, 0.3
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_host_and_path(pages: DataFrame) -> DataFrame:
    """``pages`` with host and path."""
    url = F.coalesce("url", F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(coalesce(url, ''), instr(coalesce(url, ''), '://') + 3)")).otherwise("")
    bare = F.substring_index(F.substring_index(rest, "#", 1), "?", 1)
    host = F.substring_index(bare, "/", 1)
    return pages.select("*", F.translate(host, _UPPER, _LOWER).alias("host"), F.substring(bare, F.length(host) + 1, F.lit(1 << 30)).alias("path"))


def rule_of(rules: list[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict; null where none fits."""
    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))
    fits = [((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p) for h, p, _ in ordered]
    return (
        F.coalesce(*(F.when(f, F.lit(h + p)) for f, (h, p, _) in zip(fits, ordered, strict=True))),
        F.coalesce(*(F.when(f, F.lit(v)) for f, (_, _, v) in zip(fits, ordered, strict=True))),
    )


#: Forms of variable segments: pattern and what stands for it. Digits keep their extension.
FORMS = [
    ("^[0-9]{4}-[0-9]{1,2}(-[0-9]{1,2})?$", "{date}"),
    ("^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$", "{uuid}"),
    ("^[a-f]*[0-9][0-9a-f]{7,}$|^[a-f]{8,}[0-9][0-9a-f]*$", "{hex}"),
]


def segments() -> Column:
    """All generalised segments of ``path``, null where one is empty; an empty last one is left out."""
    cut = F.split("path", "/")

    def form(s: Column) -> Column:
        out = F.when(s.rlike("^[0-9]+([.][a-z]+)?$"), F.regexp_replace(s, "^[0-9]+", "{n}"))
        for pattern, name in FORMS:
            out = out.when(s.rlike(pattern), F.lit(name))
        return out.otherwise(s)

    all_ = F.transform(F.slice(cut, 2, F.greatest(F.size(cut) - 1, F.lit(0))), lambda s: F.when(s != "", form(s)))
    return F.when(F.get(all_, F.size(all_) - 1).isNull() & (F.size(all_) > 0), F.slice(all_, 1, F.greatest(F.size(all_) - 1, F.lit(0)))).otherwise(all_)


def path_tree(paths: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(host, segments, template, labelled, bad): the template of each generalised path, down to its last segment.

    paths: host, segments, and the numbers of pages (n), labelled and bad ones. Below ``depth``, a branch that never
    parts is written ``**``.
    """
    paths = paths.groupBy("host", "segments").agg(*(F.sum(x).alias(x) for x in ("n", "labelled", "bad")))
    paths = written(paths.withColumn("template", F.lit("")).withColumn("top", F.lit("")), "paths")
    deepest = paths.agg(F.max(F.size("segments"))).first()[0] or 0
    for i in range(deepest):
        key = ["host", "template"]
        at = paths.withColumn("_s", F.get("segments", F.lit(i)))
        kids = at.where(F.col("_s").isNotNull()).groupBy(*key, "_s").agg(*(F.sum(x).alias(x) for x in ("n", "labelled", "bad")))
        whole = kids.groupBy(*key).agg(F.count("*").alias("kids"), F.sum("labelled").alias("all_labelled"), F.sum("bad").alias("all_bad"))
        # the branch against its siblings
        others, others_bad = F.col("all_labelled") - F.col("labelled"), F.col("all_bad") - F.col("bad")
        share = F.col("all_bad") / F.col("all_labelled")
        spread = F.sqrt(share * (1 - share) * (1 / F.col("labelled") + 1 / others))
        apart = F.abs(F.col("bad") / F.col("labelled") - others_bad / others)
        differs = F.when((F.col("labelled") > 0) & (others > 0) & (share > 0) & (share < 1), apart >= MERGE_Z * spread).otherwise(False)
        few = (F.col("kids") > MAX_CHILDREN) & (F.col("n") < MIN_SUPPORT)
        name = F.when(F.col("kids") == 1, F.col("_s")).when(few | ~differs, F.lit("*")).otherwise(F.col("_s"))
        named = kids.join(whole, key).select(*key, "_s", F.concat(F.lit("/"), name).alias("_step"))
        paths = at.join(named, [*key, "_s"], "left").withColumn("template", F.concat("template", F.coalesce("_step", F.lit("")))).drop("_step", "_s")
        if i < depth:
            paths = paths.withColumn("top", F.col("template"))
        paths = written(paths, "paths")  # each level reads the last one three times
    # a lone template below the first levels holds the same paths under its short name
    deeper = F.size("segments") > depth
    lone = paths.where(deeper).groupBy("host", "top").agg((F.min("template") == F.max("template")).alias("_lone"))
    short = F.when(deeper & F.col("_lone"), F.concat("top", F.lit("/**"))).otherwise(F.col("template"))
    return paths.join(lone, ["host", "top"], "left").select("host", "segments", short.alias("template"), "labelled", "bad")


def host_shares(tree: DataFrame, prior: float) -> DataFrame:
    """(host, share): each host's share of bad labels, smoothed by that of the domain above it, and so on up."""
    parts = F.split("host", "[.]")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    chain = tree.groupBy("host").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad")).select("host", "labelled", "bad", F.posexplode(above).alias("_up", "_domain"))
    sums = chain.groupBy("_domain").agg(F.sum("labelled").alias("l"), F.sum("bad").alias("b"))
    steps = chain.join(sums, "_domain").groupBy("host").agg(F.array_sort(F.collect_list(F.struct((-F.col("_up")).alias("down"), "l", "b"))).alias("_steps"))
    return steps.select("host", F.aggregate("_steps", F.lit(float(prior)), lambda p, x: (x["b"] + PRIOR_WEIGHT * p) / (x["l"] + PRIOR_WEIGHT)).alias("share"))


def filter_urls(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]] = RULES, depth: int = DEPTH) -> DataFrame:
    """page_id, host, path, rule, verdict, template and purity (the smoothed share of bad labels).

    labels: doc_id and toxic. A page's document is the first number in its path; a page is bad if that document is
    labelled toxic.
    """
    pages = with_host_and_path(pages.select("page_id", "url"))
    judged = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").alias("_doc")).agg(F.max("toxic").alias("_toxic"))
    number = F.regexp_extract("path", "/([0-9]{1,18})", 1)
    keyed = pages.select("page_id", "host", "path", segments().alias("segments"), F.when(number != "", number.cast("long")).alias("_number"))
    # counted before any join: a page without a number meets no label, and a hot number is one row a path
    seen = keyed.groupBy("host", "segments", "_number").agg(F.count("*").alias("n"))
    met = seen.where("_number is not null").join(judged, F.col("_number") == F.col("_doc"), "left")
    met = met.select("host", "segments", "n", F.when(F.col("_toxic").isNotNull(), F.col("n")).otherwise(0).alias("labelled"), F.when(F.col("_toxic") > 0, F.col("n")).otherwise(0).alias("bad"))
    none = seen.where("_number is null").select("host", "segments", "n", F.lit(0).cast("long").alias("labelled"), F.lit(0).cast("long").alias("bad"))
    tree = path_tree(met.unionByName(none), depth)
    total = tree.agg(F.sum("labelled").alias("l"), F.sum("bad").alias("b")).first()
    prior = min((total.b or 0) / total.l if total.l else 0.0, PURITY / 2)  # no label of its own rejects no template
    own = tree.groupBy("host", "template").agg(F.sum("labelled").alias("l"), F.sum("bad").alias("b")).join(host_shares(tree, prior), "host")
    pure = own.select("host", "template", "l", ((F.col("b") + PRIOR_WEIGHT * F.col("share")) / (F.col("l") + PRIOR_WEIGHT)).alias("purity"))
    scored = tree.join(pure, ["host", "template"]).select("host", "segments", "template", "purity", F.when(F.col("l") > 0, PURITY).otherwise(2 * PURITY).alias("least"))
    same = (keyed["host"] == scored["host"]) & (keyed["segments"] == scored["segments"])
    rule, verdict = rule_of(rules)
    out = keyed.join(scored, same, "left")
    learned = F.when(F.col("purity") >= F.col("least"), "block").otherwise("allow")
    return out.select("page_id", keyed["host"], "path", "template", "purity", "least").withColumn("rule", rule).withColumn("verdict", F.coalesce(verdict, learned)).select("page_id", "host", "path", "rule", "verdict", "template", "purity")


def oracle_sql(depth: int = DEPTH) -> str:
    """The same query in DuckDB SQL."""
    levels = [f"s{i}" for i in range(1, depth + 1)]
    cols = ", ".join(levels)

    def seg(i: int) -> str:
        s = f"string_split(path, '/')[{i + 1}]"
        return f"case when {s} is null or {s} = '' then null when regexp_matches({s}, '^[0-9]+([.][a-z]+)?$') then regexp_replace({s}, '^[0-9]+', '{{n}}') " + "".join(f"when regexp_matches({s}, '{p}') then '{n}' " for p, n in FORMS) + f"else {s} end"

    ordered = sorted(RULES, key=lambda r: (-len(r[0] + r[1]), r))
    fits = [(f"(host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}')", h + p, v) for h, p, v in ordered]
    parts = [
        "r as (select page_id, case when strpos(coalesce(url, ''), '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages)",
        "b as (select page_id, split_part(split_part(rest, '#', 1), '?', 1) as bare from r)",
        f"p as (select page_id, translate(split_part(bare, '/', 1), '{_UPPER}', '{_LOWER}') as host, substr(bare, length(split_part(bare, '/', 1)) + 1) as path from b)",
        f"k as (select page_id, host, path, try_cast(nullif(regexp_extract(path, '/([0-9]{{1,18}})', 1), '') as bigint) as number, {', '.join(f'{seg(i)} as {c}' for i, c in enumerate(levels, 1))}, ({seg(depth + 1)}) is not null as deeper from p)",
        "j as (select doc_id, max(toxic) as toxic from labels where toxic is not null group by doc_id)",
        f"t0 as (select host, {cols}, deeper, '' as template, count(*) as n, count(toxic) as labelled, sum(case when toxic > 0 then 1 else 0 end) as bad from k left join j on number = doc_id group by host, {cols}, deeper)",
    ]
    for i, c in enumerate(levels):
        parts += [
            f"c{i} as (select host, template, {c}, sum(n) as n, sum(labelled) as labelled, sum(bad) as bad from t{i} where {c} is not null group by host, template, {c})",
            f"w{i} as (select host, template, count(*) as kids, sum(labelled) as al, sum(bad) as ab from c{i} group by host, template)",
            f"n{i} as (select host, template, {c}, '/' || case when kids = 1 then {c} when (kids > {MAX_CHILDREN} and n < {MIN_SUPPORT}) or not (case when labelled > 0 and al - labelled > 0 and ab / al > 0 and ab / al < 1 then "
            f"abs(bad / labelled - (ab - bad) / (al - labelled)) >= {MERGE_Z}::double * sqrt((ab / al) * (1 - ab / al) * (1 / labelled + 1 / (al - labelled))) else false end) then '*' else {c} end as step from c{i} join w{i} using (host, template))",
            f"t{i + 1} as (select host, {cols}, deeper, t.template || coalesce(step, '') as template, n, labelled, bad from t{i} t left join n{i} using (host, template, {c}))",
        ]
    last = f"t{depth}"
    parts += [
        f"z as (select host, {cols}, deeper, template || case when deeper then '/**' else '' end as template, labelled, bad from {last})",
        f"q as (select least(case when sum(labelled) > 0 then sum(bad) / sum(labelled) else 0 end, {PURITY / 2}::double) as prior from z)",
        "hs as (select host, string_split(host, '.') as ps, sum(labelled) as l, sum(bad) as b from z group by host)",
        "ch as (select host, l, b, ps, unnest(range(1, len(ps) + 1)) as i from hs)",
        "dm as (select array_to_string(ps[i:], '.') as domain, array_to_string(ps[i + 1:], '.') as above, sum(l) as l, sum(b) as b, len(ps) - i as d from ch group by 1, 2, len(ps) - i)",
        f"sh as (select domain, d, (b + {PRIOR_WEIGHT}::double * prior) / (l + {PRIOR_WEIGHT}::double) as share from dm, q where d = 0 union all select dm.domain, dm.d, (dm.b + {PRIOR_WEIGHT}::double * sh.share) / (dm.l + {PRIOR_WEIGHT}::double) from dm join sh on dm.above = sh.domain and dm.d = sh.d + 1)",
        f"u as (select z.host as host, template, (sum(bad) + {PRIOR_WEIGHT}::double * any_value(share)) / (sum(labelled) + {PRIOR_WEIGHT}::double) as purity, case when sum(labelled) > 0 then {PURITY}::double else {2 * PURITY}::double end as least from z join hs on hs.host = z.host join sh on sh.domain = z.host and d = len(ps) - 1 group by z.host, template)",
    ]
    same = " and ".join(f"k.{c} is not distinct from z.{c}" for c in levels)
    rule = "case " + " ".join(f"when {f} then '{r}'" for f, r, _ in fits) + " end"
    verdict = "case " + " ".join(f"when {f} then '{v}'" for f, _, v in fits) + " when purity >= least then 'block' else 'allow' end"
    return f"with recursive {', '.join(parts)}, o as (select page_id, k.host as host, path, z.template as template, purity, least from k join z on k.host = z.host and k.deeper = z.deeper and {same} join u on u.host = z.host and u.template = z.template) select page_id, host, path, {rule} as rule, {verdict} as verdict, template, purity from o"
