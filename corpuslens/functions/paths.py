"""Path, URL and glob columns."""

from __future__ import annotations

import fnmatch
from functools import reduce

from pyspark.sql import Column, functions as F

from corpuslens import fixed_values as fixed
from corpuslens.functions.text import strip

__all__ = [
    "suffix", "splitext", "file_name", "top_segment", "map_lookup", "supported_language", "reporting_language",
    "resolve_language", "normalise_folder", "parse_folders", "has_parent_reference", "in_folders",
    "in_folder_column", "matches_globs", "glob_to_regex", "ignored_directory", "repo_path_from_url", "repo_key",
    "project_title", "module_name", "ignore_pattern", "toctree_entry", "is_preserved_artifact", "is_log_artifact",
]


def suffix(name: Column) -> Column:
    """Text from the last dot on, '' if there is none."""
    return F.regexp_extract(name, r"(\.[^./]+)$", 1)


def splitext(name: Column) -> Column:
    """Extension in the os.path sense: leading dots of a file name do not start one."""
    return F.regexp_extract(name, r"(?:^|/)\.*[^./][^/]*?(\.[^./]*)$", 1)


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def top_segment(path: Column) -> Column:
    return F.substring_index(path, "/", 1)


def map_lookup(key: Column, values: dict[str, str]) -> Column:
    """Value for the key from a fixed table held in the plan, null if absent."""
    pairs = [F.lit(part) for item in values.items() for part in item]
    return F.try_element_at(F.create_map(*pairs), key)


def supported_language(name: Column) -> Column:
    """case-sensitive extension to a language with block analysis."""
    return map_lookup(suffix(name), fixed.SUPPORTED_EXTENSIONS)


def reporting_language(name: Column) -> Column:
    """lower-cased extension to a reporting language."""
    return map_lookup(splitext(F.lower(name)), fixed.REPORTING_EXTENSIONS)


def resolve_language(path: Column, language: Column) -> Column:
    """F16: the given language lower-cased, else the one the extension implies, else ''."""
    by_extension = map_lookup(splitext(F.lower(path)), fixed.SUPPORTED_EXTENSIONS)
    return F.coalesce(F.nullif(F.lower(language), F.lit("")), by_extension, F.lit(""))


def _strip(text: Column, characters: str) -> Column:
    return F.btrim(text, F.lit(characters))


def normalise_folder(folder: Column) -> Column:
    """trim blanks, quotes, blanks, then slashes."""
    return _strip(strip(_strip(strip(folder), "\"'")), "/")


def parse_folders(text: Column) -> Column:
    """folders from text separated by commas or line breaks, empties dropped."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), r"[\n,]+"), normalise_folder)
    return F.filter(parts, lambda folder: folder != "")


def has_parent_reference(path: Column) -> Column:
    """Whether the path leaves its root through '..'."""
    return path.startswith("..") | F.contains(F.concat(F.lit("/"), path, F.lit("/")), F.lit("/../"))


def _strip_python(value: str) -> str:
    return value.strip().strip("\"'").strip().strip("/")


def in_folders(path: Column, folders: list[str] | None) -> Column:
    """path equals a folder or lies below it; no folders keeps all."""
    wanted = [folder for folder in map(_strip_python, folders or []) if folder]
    if not wanted:
        return F.lit(True)
    clean = _strip(path, "/")
    tests = [(clean == folder) | clean.startswith(folder + "/") for folder in wanted]
    return reduce(Column.__or__, tests)


def in_folder_column(path: Column, folders: Column) -> Column:
    """F3 with the folders of each row in an array column; an empty or null array keeps all."""
    clean = _strip(path, "/")
    hit = F.exists(folders, lambda folder: (clean == folder) | clean.startswith(F.concat(folder, F.lit("/"))))
    return F.coalesce(F.size(folders) <= 0, F.lit(True)) | hit


def matches_globs(name: Column, globs: list[str]) -> Column:
    """the name, or the name followed by '/', matches one of the shell patterns."""
    if not globs:
        return F.lit(False)
    pattern = "|".join(f"(?:{fnmatch.translate(glob)})" for glob in globs).replace("\\Z", "\\z")
    return name.rlike(f"^(?:{pattern})") | F.concat(name, F.lit("/")).rlike(f"^(?:{pattern})")


def glob_to_regex(glob: Column) -> Column:
    """F4 for patterns held in a column: an anchored regex equal to the shell pattern."""
    out = F.regexp_replace(glob, r"([\\.^$+{}()|])", r"\\$1")
    out = F.regexp_replace(out, r"\[(?![^\]]+\])", r"\\[")
    out = F.regexp_replace(out, r"\[!", "[^")
    out = F.regexp_replace(F.regexp_replace(out, r"\*", ".*"), r"\?", ".")
    return F.concat(F.lit("^(?s:"), out, F.lit(")$"))


def ignored_directory(path: Column, directories=fixed.IGNORED_DIRECTORIES) -> Column:
    """one of the path's directories is ignored; the last segment is the file itself."""
    parts = F.split(path, "/")
    return F.arrays_overlap(F.slice(parts, F.lit(1), F.size(parts) - 1), F.array(*map(F.lit, directories)))


def repo_path_from_url(url: Column) -> Column:
    """S3: owner/repo of an http(s) URL; other text is returned unchanged."""
    path = _strip(F.regexp_extract(url, r"^https?://[^/?#]*([^?#]*)", 1), "/")
    return F.when(url.rlike(r"^https?://"), F.regexp_replace(path, r"\.git$", "")).otherwise(url)


def repo_key(repo_path: Column) -> Column:
    """Key safe in a file name; 'unknown' for nothing."""
    clean = _strip(strip(F.coalesce(repo_path, F.lit(""))), "/")
    return F.coalesce(F.nullif(F.regexp_replace(clean, r"[^A-Za-z0-9._-]+", "__"), F.lit("")), F.lit("unknown"))


def project_title(repo_path: Column) -> Column:
    """Last segment with '-' and '_' as blanks, in title case; 'Project' for nothing."""
    last = F.substring_index(F.rtrim(repo_path, F.lit("/")), "/", -1)
    title = F.initcap(strip(F.translate(last, "-_", "  ")))
    return F.coalesce(F.nullif(title, F.lit("")), F.lit("Project"))


def module_name(path: Column) -> Column:
    """Dotted module of a file path."""
    return F.translate(F.regexp_replace(path, r"(/__init__\.py|\.py)$", ""), "/", ".")


def ignore_pattern(path: Column) -> Column:
    """Glob that ignores one file wherever its tree is mounted."""
    return F.concat(F.lit("*/"), F.ltrim(path, F.lit("/")))


def toctree_entry(path: Column, source_dir: str = "docs") -> Column:
    """Navigation entry for an output path."""
    prefix = source_dir + "/"
    entry = F.when(path.startswith(prefix), F.substring(path, len(prefix) + 1, 1 << 30)).otherwise(path)
    return F.regexp_replace(entry, r"\.rst$", "")


def is_preserved_artifact(name: Column) -> Column:
    """artifacts a new run takes over from the last one."""
    return name.rlike(fixed.PRESERVED_ARTIFACTS)


def is_log_artifact(name: Column) -> Column:
    """artifacts listed as logs."""
    return name.rlike(fixed.LOG_ARTIFACTS)
