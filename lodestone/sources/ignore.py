"""Rules of ignore files, as git reads them, over columns of paths."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _pattern(glob: str) -> str:
    """A regular expression for a glob: * and ? stop at a slash, ** does not, [...] is a class, a backslash quotes."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i) and (i == 0 or glob[i - 1] == "/"):
            out.append("(?:.*/)?")
            i += 3
            continue
        if glob[i:] == "**" and (i == 0 or glob[i - 1] == "/"):
            out.append(".+")
            break
        if c == "*":
            while glob[i + 1 : i + 2] == "*":
                i += 1
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[" and "]" in glob[i + 2 :]:
            end = glob.index("]", i + 2)
            inside = glob[i + 1 : end]
            negated = inside[0] in "!^"
            items = inside[negated:].replace("\\", "\\\\").replace("[", "\\[")
            out.append(f"(?!/)[{'^' if negated else ''}{items}]")
            i = end
        elif c == "\\" and i + 1 < len(glob):
            i += 1
            out.append(re.escape(glob[i]))
        else:
            out.append(re.escape(c))
        i += 1
    return "".join(out)


class IgnoreRules:
    """Rules from (folder, text of its ignore file), weaker ones first: the last rule that matches a path, or a folder above
    it, decides; what lies in an ignored folder cannot be taken back."""

    def __init__(self, files: list[tuple[str, str]]) -> None:
        self.rules: list[tuple[re.Pattern, bool, bool]] = []
        for folder, text in files:
            for line in text.splitlines():
                self._add(folder, line)

    def _add(self, folder: str, line: str) -> None:
        line = re.sub(r"(?<!\\)((?:\\\\)*)[ \t]+$", r"\1", line.rstrip("\r\n"))
        if not line or line.startswith("#"):
            return
        back = line.startswith("!")
        line = line[back:]
        only_folders = line.endswith("/")
        line = line.rstrip("/")
        if not line:
            return
        anchored = "/" in line
        pattern = _pattern(line.removeprefix("/"))
        head = re.escape(folder + "/") if folder else ""
        try:
            self.rules.append((re.compile(f"{head}{'' if anchored else '(?:.*/)?'}{pattern}"), back, only_folders))
        except re.error:
            return  # git skips what it cannot read

    def _decides(self, path: str, is_folder: bool) -> bool:
        for pattern, back, only_folders in reversed(self.rules):
            if (is_folder or not only_folders) and pattern.fullmatch(path):
                return not back
        return False

    def ignored(self, path: str) -> bool:
        """Whether a file is ignored, itself or by a folder above it."""
        parts = path.split("/")
        return any(self._decides("/".join(parts[:n]), True) for n in range(1, len(parts))) or self._decides(path, False)

    def column(self, path: Column) -> Column:
        rules = self

        @F.pandas_udf("boolean")
        def ignored(paths: pd.Series) -> pd.Series:
            return paths.map(lambda p: p is not None and rules.ignored(p)).astype(bool)

        return ignored(path)
