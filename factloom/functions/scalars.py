"""Scalar functions as Column expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def format_size(size: Column) -> Column:
    kb = 1024
    return (
        F.when(size < kb, F.concat(size.cast("string"), F.lit(" B")))
        .when(size < kb**2, F.format_string("%.2f KB", size / kb))
        .when(size < kb**3, F.format_string("%.2f MB", size / kb**2))
        .otherwise(F.format_string("%.2f GB", size / kb**3))
    )


def squeezed(text: Column) -> Column:
    """White space collapsed to single blanks, ends trimmed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def unquoted(text: Column) -> Column:
    return F.btrim(text, F.lit("'\"`"))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def any_suffix(path: Column, suffixes: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [path.endswith(s) for s in suffixes])


def is_test_file(path: Column) -> Column:
    return path.contains(".test.") | path.contains(".spec.") | path.endswith(".d.ts") | path.contains("__tests__") | path.contains("__mocks__")


def package_name(specifier: Column) -> Column:
    """The npm package of an import specifier; scoped names keep two parts."""
    p = F.split(specifier, "/")
    return F.when(specifier.startswith("@"), F.array_join(F.slice(p, 1, 2), "/")).otherwise(p[0])


def is_identifier(text: Column) -> Column:
    return text.rlike(r"^[A-Za-z_][A-Za-z0-9_]*$")


def folder_of(path: Column) -> Column:
    """The path without its last part; empty at the top."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def file_kind(path: Column) -> Column:
    """ts, tsx, js, jsx or json by extension, else unknown."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.when(ext.isin("ts", "tsx", "js", "jsx", "json"), ext).otherwise("unknown")


def symbol_file_kind(path: Column) -> Column:
    """What a changed file is: code, style, markup, data or other."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return (
        F.when(ext.isin("ts", "tsx", "js", "jsx"), "code").when(ext.isin("css", "less", "scss", "sass"), "style").when(ext.isin("md", "mdx", "html"), "markup")
        .when(ext.isin("json", "yaml", "yml"), "data").otherwise("other")
    )


def in_folder(path: Column, folder: Column) -> Column:
    """Whether path is folder or below it."""
    return (path == folder) | path.startswith(F.concat(folder, F.lit("/")))


def has_segment(path: Column, folder: Column) -> Column:
    """Whether folder's parts stand in path one after the other, at any depth."""
    return F.contains(F.concat(F.lit("/"), path, F.lit("/")), F.concat(F.lit("/"), folder, F.lit("/")))


def in_excluded(path: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [path.contains(p.removesuffix("/**")) for p in patterns], F.lit(False))


def default_export_name(line: Column) -> Column:
    """The name in `export default name`, also behind a call or a keyword; `default` where it has none."""
    name = F.regexp_extract(line, r"export\s+default\s+(?:async\s+)?(?:abstract\s+)?(?:function\*?\s+|class\s+|new\s+)?([A-Za-z_$][\w$]*)", 1)
    return F.when(name.isin("", "function", "class", "async", "extends"), "default").otherwise(name)


def short_hash(text: Column) -> Column:
    """Six hexadecimal letters that name a text."""
    return F.substring(F.md5(text), 1, 6)


def absolute(path: Column, root: str) -> Column:
    """Paths under root where they are relative."""
    return F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), path))


def glob_regex(glob: str) -> str:
    """A regular expression for a glob; `**/` stands for any number of folders, none included."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            c = glob[i]
            if c == "{" and "}" in glob[i:]:
                shut = glob.index("}", i)
                out, i = out + "(?:" + "|".join(re.escape(x) for x in glob[i + 1 : shut].split(",")) + ")", shut + 1
                continue
            out += "[^/]*" if c == "*" else "[^/]" if c == "?" else "\\" + c if c in r".+()[]{}^$|\\" else c
            i += 1
    return f"^{out}$"
