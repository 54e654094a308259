"""Previews of TeX sources as flat rows of a tree: each piece with its kind, content, depth and the place of the piece around it.

A source is cut into tokens by one expression; a stack of open pieces turns them into rows. Sources are handled one by one inside
Arrow tasks, nothing is shuffled, and nesting of any depth is a list, not a call.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.text import width_fraction
from quire.sources.tables import table

#: Environments that are shown as one formula, and as lists; commands that style their argument.
FORMULAS = ("equation", "align", "gather", "multline", "eqnarray", "displaymath", "math")
LISTS = {"itemize": "list", "enumerate": "ordered"}
STYLES = {"textbf": "bold", "textit": "italic", "emph": "italic", "underline": "underline", "texttt": "mono"}
TOKEN = re.compile(
    r"(?P<comment>%[^\n]*)"
    r"|(?P<display>\$\$[\s\S]*?\$\$|\\\[[\s\S]*?\\\]|\\begin\{(?P<env>" + "|".join(FORMULAS) + r")(?P<star>\*?)\}[\s\S]*?\\end\{(?P=env)(?P=star)\})"
    r"|(?P<math>\$(?:\\[\s\S]|[^$\\])+\$|\\\([\s\S]*?\\\))"
    r"|\\(?P<edge>begin|end)\s*\{(?P<name>[^}]*)\}(?:\[[^\]]*\])?"
    r"|(?P<image>\\includegraphics\s*(?:\[[^\]]*\])?\s*\{[^}]*\})"
    r"|(?P<item>\\item\b\s*(?:\[[^\]]*\])?)"
    r"|(?P<break>\\\\(?:\[[^\]]*\])?|\\newline\b)"
    r"|\\(?P<command>[a-zA-Z]+)\*?(?:\[[^\]]*\])?\s*(?P<opens>\{)?"
    r"|\\(?P<escape>[\s\S])"
    r"|(?P<group>\{)|(?P<close>\})|(?P<paragraph>\n[ \t]*\n\s*)"
    r"|(?P<text>[^\\$%{}\n]+(?:\n(?![ \t]*\n)[^\\$%{}\n]*)*|[\s\S])"
)
NAMES = ["pos", "depth", "parent", "kind", "content"]


def pieces(source: str) -> list[tuple[int, int, int, str, str]]:
    """(place, depth, place of the piece around it or -1, kind, content) of each piece of a source, in order.

    Braces, environments and items that are never closed end with the source; ends without a beginning are text.
    """
    rows: list[tuple[int, int, int, str, str]] = []
    stack: list[tuple[int, str]] = []  # place and name of open pieces

    def add(kind: str, content: str, opens: str | None = None) -> None:
        at = len(rows)
        if kind == "text" and rows and rows[-1][3] == "text" and rows[-1][2] == (stack[-1][0] if stack else -1):
            rows[-1] = (*rows[-1][:4], rows[-1][4] + content)
            return
        rows.append((at, len(stack), stack[-1][0] if stack else -1, kind, content))
        if opens is not None:
            stack.append((at, opens))

    def close(name: str) -> bool:
        """Closes the innermost open piece of a name and what is open in it; a brace doesn't close beyond an environment."""
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][1] == name:
                del stack[i:]
                return True
            if name == "}" and stack[i][1].startswith("env:"):
                return False
        return False

    for m in TOKEN.finditer(source):
        body = m[0]
        if m["comment"]:
            continue
        if m["display"]:
            add("display", body)
        elif m["math"]:
            add("math", body[1:-1] if body[0] == "$" else body[2:-2])
        elif m["edge"] == "begin":
            add(LISTS.get(m["name"], "box"), m["name"], f"env:{m['name']}")
        elif m["edge"]:
            if not close(f"env:{m['name']}"):
                add("text", body)
        elif m["item"]:
            # An item ends the one before it in the same list.
            inner = next((n for _, n in reversed(stack) if n == "item" or n.startswith("env:")), None)
            if inner == "item":
                close("item")
            add("item", "", "item")
        elif m["image"]:
            add("image", body)
        elif m["break"]:
            add("break", "")
        elif m["command"]:
            add(STYLES.get(m["command"], "command") if m["opens"] else "command", m["command"], "}" if m["opens"] else None)
        elif m["escape"]:
            add("text", m["escape"])
        elif m["group"]:
            add("group", "", "}")
        elif m["close"]:
            if not close("}"):
                add("text", body)
        elif m["paragraph"]:
            add("paragraph", "")
        else:
            add("text", body)
    return rows


def preview_tree(df: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (key, pos, depth, parent, kind, content, width) of the pieces of each source; width is the part of the line that an image takes."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            for k, source in zip(b.column(0), b.column(1).to_pylist()):
                if rows := pieces(source or ""):
                    cols = list(zip(*rows))
                    yield pa.RecordBatch.from_arrays([pa.array([k.as_py()] * len(rows), b.schema.field(0).type), *(pa.array(c, pa.int32()) for c in cols[:3]), pa.array(cols[3]), pa.array(cols[4])], [key, *NAMES])

    out = df.select(key, text).mapInArrow(run, f"{key} {kind}, pos int, depth int, parent int, kind string, content string")
    return out.withColumn("width", F.when(F.col("kind") == "image", width_fraction(F.col("content"))))


def _sources(s, d) -> DataFrame:
    """A list with a styled name, a formula, an image and a box around each part's name."""
    text = F.concat(F.lit("Intro \\textbf{"), "p_name", F.lit(" \\emph{in}} 5\\% % note\n\n\\begin{enumerate}\\item $x_{1}$\\\\\n\\item \\begin{center}\\includegraphics[width=0."), F.col("p_size").cast("string"), F.lit("\\textwidth]{f}\\end{center}\\end{enumerate}{"), "p_brand")
    return table(s, d, "part").select("p_partkey", text.alias("source"))


QUERIES = {
    "preview_tree": lambda s, d: preview_tree(_sources(s, d), "p_partkey", "source"),
    "preview_kinds": lambda s, d: preview_tree(table(s, d, "documents"), "doc_id", "text").groupBy("doc_id", "kind").agg(F.count("*").alias("n"), F.max("depth").alias("deepest")),
}
_ROWS = [
    (0, 0, -1, "text", "'Intro '"), (1, 0, -1, "bold", "'textbf'"), (2, 1, 1, "text", "p_name || ' '"), (3, 1, 1, "italic", "'emph'"), (4, 2, 3, "text", "'in'"), (5, 0, -1, "text", "' 5% '"), (6, 0, -1, "paragraph", "''"),
    (7, 0, -1, "ordered", "'enumerate'"), (8, 1, 7, "item", "''"), (9, 2, 8, "math", "'x_{1}'"), (10, 2, 8, "break", "''"), (11, 2, 8, "text", "chr(10)"), (12, 1, 7, "item", "''"), (13, 2, 12, "box", "'center'"),
    (14, 3, 13, "image", "'\\includegraphics[width=0.' || p_size || '\\textwidth]{f}'"), (15, 0, -1, "group", "''"), (16, 1, 15, "text", "p_brand"),
]
ORACLE_SQL = {
    "preview_tree": " union all ".join(f"select p_partkey, {p}::int as pos, {d}::int as depth, {u}::int as parent, '{k}' as kind, {c} as content, {'cast(0.0 + (' + chr(39) + '0.' + chr(39) + ' || p_size)::double as double)' if k == 'image' else 'cast(null as double)'} as width from part" for p, d, u, k, c in _ROWS),
}
