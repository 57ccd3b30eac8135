"""Names to definitions: imports, base classes, types of variables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.scalar import is_interface

TS_EXTENSIONS = (".ts", ".tsx", ".js", ".jsx")


def _names(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ","), lambda n: F.trim(F.element_at(F.split(F.trim(n), r"\s+as\s+"), 1))), lambda n: n != "")


def lines_of(files: DataFrame) -> DataFrame:
    """service, file, language, line and text of each line of (service, path, language, content)."""
    return files.select("service", F.col("path").alias("file"), "language", F.posexplode(F.split("content", "\n")).alias("at", "text")).select("service", "file", "language", (F.col("at") + 1).alias("line"), "text")


def imports(files: DataFrame) -> DataFrame:
    """service, file, language, line, module and names of each import statement, line by line."""
    text = F.col("text")

    def rule(pattern: str, module: int, names) -> Column:
        return F.when(text.rlike(pattern), F.struct(F.regexp_extract(text, pattern, module).alias("module"), names(pattern).alias("names")))

    star = lambda _: F.array(F.lit("*"))
    listed = lambda group: lambda p: _names(F.regexp_extract(text, p, group))
    one = lambda group: lambda p: F.array(F.regexp_extract(text, p, group))
    last = lambda p: F.array(F.element_at(F.split(F.regexp_extract(text, p, 1), r"\\"), -1))
    script = F.coalesce(
        rule(r"import\s+\{([^}]+)\}\s+from\s+['\"]([^'\"]+)['\"]", 2, listed(1)),
        rule(r"import\s+(\w+)\s+from\s+['\"]([^'\"]+)['\"]", 2, one(1)),
        rule(r"import\s+\*\s+as\s+(\w+)\s+from\s+['\"]([^'\"]+)['\"]", 2, star),
    )
    python = F.coalesce(rule(r"^from\s+([\w.]+)\s+import\s+(.+)", 1, listed(2)), rule(r"^import\s+([\w.]+)", 1, star))
    found = (
        F.when(F.col("language").isin("typescript", "javascript"), script)
        .when(F.col("language") == "python", python)
        .when(F.col("language") == "go", rule(r"^\s*\"([^\"]+)\"", 1, star))
        .when(F.col("language") == "php", rule(r"^use\s+([\w\\]+)(?:\s+as\s+\w+)?;", 1, last))
        .when(F.col("language") == "csharp", rule(r"^using\s+([\w.]+);", 1, star))
    )
    return lines_of(files).withColumn("i", found).where(F.col("i").isNotNull()).select("service", "file", "language", "line", "i.module", "i.names")


def normalized(path: Column) -> Column:
    """Path without ``.`` and with ``..`` resolved."""
    parts = F.split(path, "/")
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, x: F.when(x.isin("", "."), acc).when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, x)))
    return F.array_join(kept, "/")


def resolve_imports(found: DataFrame, files: DataFrame) -> DataFrame:
    """Imports with resolved file, external flag and confidence.

    A relative module becomes candidate paths in order of preference; one
    equi-join with the files and a partial minimum picks the first that exists.
    """
    directory = F.regexp_replace("file", "[^/]*$", "")
    dots = F.length(F.regexp_extract("module", r"^(\.+)", 1))
    up = F.concat(F.repeat(F.lit("../"), F.greatest(dots - 1, F.lit(0))), F.replace(F.regexp_replace("module", r"^\.+", ""), F.lit("."), F.lit("/")))
    relative = F.col("module").rlike(r"^[./]")
    base = F.when(F.col("language") == "python", normalized(F.concat(directory, up))).otherwise(normalized(F.concat(directory, "module")))
    script = [*((e, 0.9) for e in TS_EXTENSIONS), *((f"/index{e}", 0.85) for e in TS_EXTENSIONS)]
    options = lambda pairs: F.array(*(F.struct(F.lit(k).alias("k"), F.concat("base", F.lit(end)).alias("path"), F.lit(c).alias("confidence")) for k, (end, c) in enumerate(pairs)))
    tries = F.when(F.col("language").isin("typescript", "javascript"), options(script)).when(F.col("language") == "python", options([(".py", 0.9), ("/__init__.py", 0.85)]))
    placed = found.withColumn("external", ~relative).withColumn("base", base).withColumn("tries", F.when(relative, tries))
    key = ["service", "file", "line", "module"]
    exploded = placed.where("tries IS NOT NULL").select(*key, F.explode("tries").alias("t")).select(*key, "t.*")
    there = files.select("service", "path")
    best = exploded.join(there, ["service", "path"]).groupBy(*key).agg(F.min_by(F.struct("path", "confidence"), "k").alias("b"))
    joined = placed.join(best, key, "left")
    return joined.select("service", "file", "language", "line", "module", "names", "external", F.col("b.path").alias("resolved"), F.coalesce("b.confidence", F.when(F.col("external"), 0.6).otherwise(0.85)).alias("confidence"))


def import_stats(resolved: DataFrame) -> DataFrame:
    return resolved.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("resolved").isNotNull()).alias("resolved"), F.count_if("external").alias("external"))


def heritage(classes: DataFrame) -> DataFrame:
    """EXTENDS or IMPLEMENTS of each class and base: confidence 0.9 if the base is defined, else 0.7; of equal names the last definition."""
    index = classes.groupBy(F.col("name").alias("base")).agg(F.max_by("file", F.struct("file", "ordinal")).alias("base_file"))
    based = classes.select("service", "file", "language", "name", F.explode("bases").alias("base")).where(~F.lower("base").isin("object", ""))
    kind = F.when(is_interface(F.col("base"), F.col("language")), "IMPLEMENTS").otherwise("EXTENDS")
    return based.join(index, "base", "left").select("service", "file", "name", "base", "base_file", kind.alias("type"), F.when(F.col("base_file").isNotNull(), 0.9).otherwise(0.7).alias("confidence")).distinct()


def heritage_stats(edges: DataFrame) -> DataFrame:
    return edges.agg(F.count_if(F.col("type") == "EXTENDS").alias("extends"), F.count_if(F.col("type") == "IMPLEMENTS").alias("implements"), F.count_if(F.col("base_file").isNotNull()).alias("resolved"))


def bindings(files: DataFrame, classes: DataFrame, symbols: DataFrame) -> DataFrame:
    """Type of each variable of a file: annotations before constructors before return types, then the first line."""
    text = F.trim("text")

    def rule(pattern: str, name: int, kind: int, tier: int) -> Column:
        return F.when(text.rlike(pattern), F.struct(F.regexp_extract(text, pattern, name).alias("variable"), F.regexp_extract(text, pattern, kind).alias("type"), F.lit(tier).alias("tier")))

    variable = r"(?:const|let|var)\s+(\w+)\s*"
    script = F.coalesce(rule(variable + r":\s*([\w.]+)", 1, 2, 0), rule(variable + r"=\s*new\s+(\w+)", 1, 2, 1), rule(variable + r"=\s*(\w+)\(", 1, 2, 2))
    python = F.coalesce(rule(r"(\w+)\s*:\s*([\w.]+)\s*=", 1, 2, 0), rule(r"(\w+)\s*=\s*([A-Z]\w+)\(", 1, 2, 1))
    sharp = F.coalesce(rule(r"([A-Z]\w+(?:<[\w,\s]+>)?)\s+(\w+)\s*=", 2, 1, 0), rule(r"(?:var|[A-Z]\w+)\s+(\w+)\s*=\s*new\s+(\w+)", 1, 2, 1))
    golang = F.coalesce(rule(r"var\s+(\w+)\s+\*?([\w.]+)", 1, 2, 0), rule(r"(\w+)\s*:=\s*&?([A-Z]\w+)\s*\{", 1, 2, 1))
    php = F.coalesce(rule(r"(?:@var\s+)?([A-Z]\w+)\s+\$(\w+)", 2, 1, 0), rule(r"\$(\w+)\s*=\s*new\s+(\w+)", 1, 2, 1))
    language = F.col("language")
    found = F.when(language == "typescript", script).when(language == "python", python).when(language == "csharp", sharp).when(language == "go", golang).when(language == "php", php)
    raw = lines_of(files).withColumn("b", found).where(F.col("b").isNotNull()).select("service", "file", "language", "line", "b.*")
    returns = symbols.where(F.col("return_type").isNotNull()).groupBy(F.col("name").alias("type")).agg(F.max_by("return_type", F.struct("file", "ordinal")).alias("returned"))
    known = classes.select(F.col("name").alias("type")).distinct().withColumn("is_class", F.lit(True))
    typed = raw.join(returns, "type", "left").join(known, "type", "left")
    kept = typed.where(((F.col("tier") != 2) | F.col("returned").isNotNull()) & ~((language == "python") & (F.col("tier") == 1) & F.col("is_class").isNull()))
    named = kept.withColumn("type", F.when(F.col("tier") == 2, F.col("returned")).otherwise(F.col("type")))
    return named.groupBy("service", "file", "variable").agg(F.min_by(F.struct("type", "tier"), F.struct("tier", "line")).alias("b")).select("service", "file", "variable", "b.type", "b.tier", (F.lit(1.0) - F.col("b.tier") * 0.1).alias("confidence"))


def resolve_calls(sites: DataFrame, bound: DataFrame, classes: DataFrame) -> DataFrame:
    """Calls ``object.method`` upgraded to the method of the object's class."""
    method = F.regexp_extract("callee", r"([^.]*)$", 1)
    objects = sites.where(F.col("callee").contains(".")).withColumn("variable", F.regexp_extract("callee", r"^(.*)\.[^.]*$", 1)).withColumn("method", method)
    methods = classes.select(F.col("name").alias("type"), F.col("file").alias("class_file"), F.explode("methods").alias("method")).distinct()
    joined = objects.drop("confidence", "reason").join(bound, ["service", "file", "variable"]).join(methods, ["type", "method"])
    reason = F.when(F.col("tier") == 0, "type_annotation").when(F.col("tier") == 1, "constructor_inference").otherwise("return_type_inference")
    return joined.select("service", "file", "caller", "callee", "line", "type", "method", "class_file", "confidence", reason.alias("reason"))
