"""Scalar functions over columns; all are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules


def lines(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(all columns but ``text``, line_no from 1, line): lines end at a line feed, a carriage return before it goes, and a last empty line doesn't count."""
    rows = docs.select(*[c for c in docs.columns if c != text], F.posexplode(F.split(F.regexp_replace(F.col(text), "\\n$", ""), "\\r?\\n")).alias("line_no", "line"))
    return rows.withColumn("line_no", F.col("line_no") + 1)


def normalized(line: Column) -> Column:
    """Look-alike letters as the plain ones, so that patterns see them."""
    return F.translate(line, rules.CONFUSABLES, rules.PLAIN)


def folded(line: Column) -> Column:
    """String literals joined by a plus sign with single spaces become one; a second pass takes what the first brought together."""
    for _ in range(2):
        for joint in ('" + "', "' + '"):
            line = F.replace(line, F.lit(joint), F.lit(""))
    return line


def entropy(text: Column) -> Column:
    """Shannon entropy in bits of the bytes of a text; 0 for an empty one.

    The bytes become characters of their own, and a distinct one occurs as often as
    the text gets shorter without it: a scan for each distinct byte, at most 256.
    """
    n = F.octet_length(text)
    part = lambda c: F.when(c > 1, c * F.log2(c.cast("double"))).otherwise(F.lit(0.0))
    times = lambda s: F.transform(F.array_distinct(F.split(s, "")), lambda c: F.length(s) - F.length(F.replace(s, c, F.lit(""))))
    letters = F.array(F.decode(text.cast("binary"), "ISO-8859-1"))  # worked out once, wherever the optimizer moves it
    total = F.aggregate(F.get(F.transform(letters, times), F.lit(0)), F.lit(0.0), lambda a, c: a + part(c))
    return F.when(n > 0, F.log2(n.cast("double")) - total / n).otherwise(F.lit(0.0))


def extension(path: Column) -> Column:
    return F.element_at(F.split(path, "\\."), -1)


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def language(path: Column) -> Column:
    """Language of a file by its extension; null for others."""
    ext = extension(path)
    return (
        F.when(ext.isin("js", "mjs", "cjs", "jsx"), "javascript")
        .when(ext.isin("ts", "mts", "cts", "tsx"), "typescript")
        .when(ext.isin("py", "pyw"), "python")
        .when(ext.isin("rb", "rake", "gemspec"), "ruby")
        .when(ext == "rs", "rust")
    )


def scannable(path: Column) -> Column:
    """Files worth a scan, by name alone."""
    name = file_name(path)
    ends = name.endswith(rules.SKIPPED_ENDINGS[0])
    for e in rules.SKIPPED_ENDINGS[1:]:
        ends = ends | name.endswith(e)
    return extension(name).isin(rules.SOURCE_EXTENSIONS) & ~ends & ~name.isin(rules.SKIPPED_NAMES)


def in_skipped_dir(path: Column, more: list[str] = ()) -> Column:
    parts = F.split(path, "/")
    return F.arrays_overlap(F.slice(parts, F.lit(1), F.size(parts) - 1), F.array(*map(F.lit, [*rules.SKIPPED_DIRS, *more])))


def package_of(path: Column) -> Column:
    """Package that a dependency's file belongs to; null outside dependency folders.

    The last node_modules counts, with the scope if there is one; gems and site
    packages by the first folder below theirs.
    """
    node = F.nullif(F.regexp_extract(path, r"^.*node_modules/(@[^/]*/[^/]*|[^/]*)", 1), F.lit(""))
    gem = F.nullif(F.regexp_extract(path, r"^vendor/.*?gems/([^/]*)", 1), F.lit(""))
    site = F.nullif(F.regexp_extract(path, r"^\.?venv/.*?site-packages/([^/]*)", 1), F.lit(""))
    return F.when(path.contains("node_modules/"), node).otherwise(F.coalesce(gem, site))


def module_package(specifier: Column) -> Column:
    """Package of an import specifier: two parts if scoped, else one; null for relative, absolute and alias paths."""
    parts = F.split(specifier, "/")
    scoped = F.when(F.size(parts) >= 2, F.concat_ws("/", F.get(parts, F.lit(0)), F.get(parts, F.lit(1))))
    bare = F.nullif(F.get(parts, F.lit(0)), F.lit(""))
    return F.when(specifier.rlike(r"^[./$]"), None).when(specifier.startswith("@"), scoped).otherwise(bare)


def without_version(package: Column) -> Column:
    """A name without ``@version``; a scope's sign stays."""
    return F.regexp_extract(package, r"^(@?[^@]+)", 1)


def truncated(line: Column, most: int = 80) -> Column:
    """A trimmed line; above ``most`` bytes its first characters and dots."""
    t = F.trim(line)
    return F.when(F.octet_length(t) <= most, t).otherwise(F.concat(F.left(t, F.lit(most)), F.lit("...")))


def masked(value: Column) -> Column:
    return F.concat(F.left(value, F.lit(4)), F.lit("..."), F.right(value, F.lit(4)))


def script_blocks(html: Column) -> Column:
    """Bodies of script elements, one below the other."""
    return F.array_join(F.regexp_extract_all(html, F.lit(r"(?s)<script[^>]*>(.*?)</script>"), F.lit(1)), "\n")


def host_matches(host: Column, expected: Column) -> Column:
    """The same host, or one below it."""
    return (host == expected) | F.endswith(host, F.concat(F.lit("."), expected))


def under(path: Column, folder: Column) -> Column:
    """The folder itself or a path within, component by component."""
    return (path == folder) | F.startswith(path, F.concat(folder, F.lit("/")))


def cvss_score(text: Column) -> Column:
    """A number as it is; a vector by a rule of thumb: 5 and parts for what it contains, 10 at most."""
    parts = [("AV:N", 1.5), ("AC:L", 0.5), ("PR:N", 0.5), ("C:H", 1.0), ("I:H", 0.5), ("A:H", 0.5)]
    guess = F.lit(5.0)
    for part, points in parts:
        guess = guess + F.when(text.contains(part), points).otherwise(0.0)
    return F.coalesce(text.try_cast("double"), F.least(guess, F.lit(10.0)))


def cvss_severity(score: Column) -> Column:
    return F.when(score >= 9, "critical").when(score >= 7, "high").when(score >= 4, "medium").otherwise("low")


def display_label(rule: Column, package: Column, file: Column) -> Column:
    """What a finding is shown under; never null."""
    family = F.when(rule.startswith("W"), "workflows").when(rule.startswith("S"), "secrets").when(rule.startswith("H"), "hygiene").when(rule.startswith("D") | rule.startswith("V") | rule.startswith("M"), "dependencies")
    flow = F.when(file.startswith(".github/workflows/"), F.concat(F.lit("workflow:"), file_name(file)))
    return F.coalesce(package, flow, family, file, F.lit("project"))


def repository_url(url: Column) -> Column:
    """A remote as a web address: ssh forms turned round, ``.git`` and a slash at the end gone."""
    web = F.regexp_replace(F.trim(url), r"^(?:ssh://)?git@([^:/]+)[:/]", "https://$1/")
    return F.regexp_replace(web, r"(\.git)?/?$", "")


def fenced_json(text: Column) -> Column:
    """The JSON in a model's answer: of a fenced block, else from the first to the last brace."""
    fence = F.nullif(F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1), F.lit(""))
    return F.coalesce(fence, F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit("")))


def url_encoded(name: Column) -> Column:
    return F.replace(F.replace(name, F.lit("@"), F.lit("%40")), F.lit("/"), F.lit("%2F"))


def recently(published: Column, today: Column, days: int = 7) -> Column:
    return F.datediff(today, published).between(0, days)
