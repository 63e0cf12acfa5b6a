"""Evidence mining: one pass over each file yields all of its signals as rows (category, name, attrs)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from corpuslens import fixed_values as fixed
from corpuslens import functions as fn

SIGNAL = "array<struct<category:string,name:string,attrs:map<string,string>>>"


def _none() -> Column:
    return F.array().cast(SIGNAL)


def _attrs(**values: Column) -> Column:
    pairs = [part for key, value in values.items() for part in (F.lit(key), value)]
    return F.create_map(*pairs) if pairs else F.lit(None).cast("map<string,string>")


def _signal(category: Column | str, name: Column, attrs: Column | None = None) -> Column:
    category = F.lit(category) if isinstance(category, str) else category
    return F.struct(
        category.alias("category"), name.alias("name"), (_attrs() if attrs is None else attrs).alias("attrs")
    )


def _if(test: Column, signals: Column) -> Column:
    return F.when(F.coalesce(test, F.lit(False)), signals).otherwise(_none())


def path_signals(path: Column) -> Column:
    """F8: what a path alone says: file names with a meaning, packages, language."""
    name = fn.file_name(path)
    parts = F.split(path, "/")
    folders = F.slice(parts, F.lit(1), F.size(parts) - 1)
    language = fn.map_lookup(fn.splitext(name), fixed.TECHNOLOGY_EXTENSIONS)
    manager = fn.map_lookup(name, fixed.MANIFEST_MANAGERS)
    return F.concat(
        F.array(_signal("repository structure", parts[0])),
        _if(name.isin(*fixed.ENTRY_POINT_FILENAMES), F.array(_signal("entry points", path))),
        _if(manager.isNotNull(), F.array(_signal("dependency file", path, _attrs(manager=manager)))),
        _if(name.isin(*fixed.CONFIG_FILENAMES), F.array(_signal("configuration", path))),
        _if(
            (name == "__init__.py") & (F.size(parts) > 1),
            F.array(_signal("modules and packages", F.array_join(folders, "/"))),
        ),
        _if(language.isNotNull(), F.array(_signal("language", language))),
    )


def path_categories(path: Column) -> Column:
    """categories the folders of a path stand for."""
    parts = F.split(path, "/")
    folders = F.slice(parts, F.lit(1), F.size(parts) - 1)
    return F.filter(
        F.transform(folders, lambda part: fn.map_lookup(F.lower(part), fixed.SEGMENT_CATEGORIES)),
        lambda category: category.isNotNull(),
    )


def _mentions(content: Column, texts) -> Column:
    return reduce(Column.__or__, [F.contains(content, F.lit(text)) for text in texts])


def _matches(content: Column, pattern: str, group: int, hints) -> Column:
    found = F.regexp_extract_all(content, F.lit(pattern), F.lit(group))
    return F.when(_mentions(content, hints), found).otherwise(F.array().cast("array<string>"))


def scannable(path: Column, content: Column) -> Column:
    return fn.splitext(path).isin(*fixed.SCANNABLE_EXTENSIONS) & (F.coalesce(content, F.lit("")) != "")


def content_categories(path: Column, content: Column) -> Column:
    """categories the content of a scannable file shows."""
    flags = [
        F.when(_mentions(content, fixed.ROUTER_HINTS), "routers"),
        F.when(_mentions(content, fixed.MODEL_BASE_HINTS), "database models"),
        F.when(_mentions(content, fixed.JOB_HINTS) & content.rlike(fixed.JOB_PATTERN), "background jobs"),
        # The look-ahead spares the word boundary test at most positions.
        F.when(content.rlike("(?=[jJoOaAlLrR])" + fixed.AUTH_PATTERN), "authentication flow"),
    ]
    found = F.array_compact(F.array(*flags))
    return F.when(F.coalesce(scannable(path, content), F.lit(False)), found).otherwise(
        F.array().cast("array<string>")
    )


def category_signals(path: Column, content: Column) -> Column:
    """SO4: folder and content categories of a file, each once."""
    both = F.array_distinct(F.concat(path_categories(path), content_categories(path, content)))
    return F.transform(both, lambda category: _signal(category, path))


def content_signals(path: Column, content: Column) -> Column:
    """Endpoints, environment variables and imports in a scannable file."""
    extension = fn.splitext(path)

    def endpoint(decorator: Column) -> Column:
        method = F.upper(F.regexp_extract(decorator, fixed.ENDPOINT_PATTERN, 1))
        route = F.regexp_extract(decorator, fixed.ENDPOINT_PATTERN, 2)
        return _signal("API endpoints", F.concat_ws(" ", method, route), _attrs(method=method, path=route))

    endpoints = F.transform(_matches(content, fixed.ENDPOINT_PATTERN, 0, fixed.ENDPOINT_HINTS), endpoint)
    variables = F.array_distinct(_matches(content, fixed.ENV_VAR_PATTERN, 1, fixed.ENV_VAR_HINTS))
    imports = F.array_distinct(
        F.transform(
            F.regexp_extract_all(content, F.lit(fixed.IMPORT_PATTERN), F.lit(1)),
            lambda module: F.substring_index(module, ".", 1),
        )
    )
    module = F.translate(F.regexp_replace(path, r"\.py$", ""), "/", ".")
    return _if(
        scannable(path, content),
        F.concat(
            endpoints,
            F.transform(variables, lambda name: _signal("environment variables", name)),
            _if(
                extension == ".py",
                F.transform(imports, lambda top: _signal("import", top, _attrs(module=module))),
            ),
        ),
    )


def manifest_signals(path: Column, content: Column) -> Column:
    """SR9: dependencies declared in a manifest, in manifest order."""
    name = fn.file_name(path)
    manager = fn.map_lookup(name, fixed.MANIFEST_MANAGERS)
    lines = F.transform(fn.lines_of(content), lambda line: fn.strip(line))
    wanted = F.filter(lines, lambda line: (line != "") & ~line.startswith("#") & ~line.startswith("-"))
    pinned = F.transform(wanted, lambda line: fn.strip(F.split(line, r"[<>=!~\[; ]", 2)[0]))
    payload = F.from_json(
        F.when(name == "package.json", content),
        "dependencies map<string,variant>, devDependencies map<string,variant>",
    )
    empty = F.array().cast("array<string>")
    keys = F.concat(
        F.coalesce(F.map_keys(payload["dependencies"]), empty),
        F.coalesce(F.map_keys(payload["devDependencies"]), empty),
    )
    quoted = F.regexp_extract_all(
        content, F.lit(r'(?m)^[^\S\n]*+"([A-Za-z0-9_.\-]+)(?:[<>=!~ ].*)?"[^\S\n]*+,?[^\S\n]*+$'), F.lit(1)
    )
    names = (
        F.when(name == "requirements.txt", F.filter(pinned, lambda one: one != ""))
        .when(name == "package.json", keys)
        .when(name == "pyproject.toml", quoted)
        .otherwise(empty)
    )
    return _if(
        manager.isNotNull() & (F.coalesce(content, F.lit("")) != ""),
        F.transform(
            names,
            lambda one, at: _signal("external dependencies", one, _attrs(manager=manager, at=at.cast("string"))),
        ),
    )


def _exploded(files: DataFrame, signals: Column) -> DataFrame:
    # The outer form keeps Spark from deriving a "not empty" filter that would run every pattern a second time.
    rows = files.select("repo", "path", F.explode_outer(signals).alias("_s")).filter(F.col("_s").isNotNull())
    return rows.select("repo", "_s.category", "_s.name", "path", "_s.attrs")


def dependencies(files: DataFrame) -> DataFrame:
    """SR9 as rows (repo, path, name, manager, at)."""
    return _exploded(files, manifest_signals(F.col("path"), F.col("content"))).select(
        "repo", "path", "name", F.col("attrs")["manager"].alias("manager"), F.col("attrs")["at"].cast("int").alias("at")
    )


def top_level_folders(files: DataFrame) -> DataFrame:
    """Folders at the root of each repository."""
    return (
        files.filter(F.contains("path", F.lit("/")))
        .select("repo", fn.top_segment(F.col("path")).alias("name"))
        .filter(~F.col("name").isin(*fixed.IGNORED_DIRECTORIES))
        .distinct()
    )


def import_edges(imports: DataFrame, folders: DataFrame) -> DataFrame:
    """(repo, module, package) where the imported top module is a root folder of the same repository."""
    return imports.join(folders, ["repo", "name"], "left_semi").select(
        "repo", "module", F.col("name").alias("package")
    ).distinct()


def evidence(files: DataFrame, folders: DataFrame | None = None) -> DataFrame:
    """The long evidence table of scanned files, from one pass over their content.

    Imports become 'internal dependencies' edges where a root folder of the repository has their name. All rows take part
    in that look-up, under their own names, so the content need not be read again for imports alone.
    """
    path, content = F.col("path"), F.col("content")
    signals = F.concat(
        path_signals(path), category_signals(path, content), content_signals(path, content),
        manifest_signals(path, content),
    )
    folders = top_level_folders(files) if folders is None else folders
    rows = _exploded(files, signals).join(folders.withColumn("_root", F.lit(True)), ["repo", "name"], "left")
    is_import = F.col("category") == "import"
    module = F.col("attrs")["module"]
    return rows.filter(~is_import | F.col("_root")).select(
        "repo",
        F.when(is_import, "internal dependencies").otherwise(F.col("category")).alias("category"),
        F.when(is_import, F.concat(module, F.lit(" -> "), F.col("name"))).otherwise(F.col("name")).alias("name"),
        "path",
        F.when(is_import, F.create_map(F.lit("module"), module, F.lit("package"), F.col("name")))
        .otherwise(F.col("attrs"))
        .alias("attrs"),
    )


def variable_files(evidence_rows: DataFrame) -> DataFrame:
    """Every environment variable with each of its files, once; long form, so a popular variable stays spread."""
    return (
        evidence_rows.filter(F.col("category") == "environment variables").select("repo", "name", "path").distinct()
    )


def technology_stack(evidence_rows: DataFrame) -> DataFrame:
    """A10: languages with their file counts and one row per manifest."""
    languages = (
        evidence_rows.filter(F.col("category") == "language")
        .groupBy("repo", "name")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("repo", F.concat(F.col("name"), F.lit(" ("), F.col("n"), F.lit(" file(s))")).alias("name"), "n",
                F.lit(None).cast("string").alias("path"))
    )
    manifests = evidence_rows.filter(F.col("category") == "dependency file").select(
        "repo", F.col("attrs")["manager"].alias("name"), F.lit(None).cast("bigint").alias("n"), "path"
    )
    return languages.unionByName(manifests)


def distinct_entries(evidence_rows: DataFrame, category: str) -> DataFrame:
    """Distinct names of a category per repository."""
    return evidence_rows.filter(F.col("category") == category).select("repo", "name").distinct()
