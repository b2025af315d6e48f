"""A read-only Cypher subset over nodes(id, label, name, ...) and edges(src, dst, type).

MATCH (a:L {k: "v"})-[:T|U*1..3]->(b), OPTIONAL MATCH, WHERE with AND/OR/XOR/NOT,
comparisons, CONTAINS, STARTS WITH, ENDS WITH, =~, IN, IS [NOT] NULL and
EXISTS { (a)-[:T]->() } anywhere in a condition, UNWIND [..] AS x, CASE, RETURN
[DISTINCT] with aggregates and aliases, ORDER BY, SKIP, LIMIT, UNION [ALL]. Text in
single or double quotes is set aside before anything is parsed. Patterns become joins;
variable lengths become one union of joins per length up to ``MAX_HOPS``; a larger
bound, a larger LIMIT than ``MAX_ROWS`` and pairs of nodes that only longer paths join
are refused, as are write clauses and clauses that are not known.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_HOPS, MAX_ROWS = 10, 100_000
_NODE = r"\(\s*(\w*)\s*(?::\s*(\w+))?\s*(\{[^}]*\})?\s*\)"
_REL = r"(<)?-\[\s*\w*\s*(?::\s*([\w|:]+))?\s*(\*(?:\d+)?(?:\.\.(?:\d+)?)?)?\s*\]-(>)?"
_AGG = {"count": F.count, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "collect": F.collect_list}
_FUNCS = {"tolower": F.lower, "toupper": F.upper, "tostring": lambda c: c.cast("string"), "coalesce": F.coalesce, "substring": lambda c, a, n: F.substring(c, a + 1, n)}


def _split(text: str, word: str) -> list[str]:
    """Cut at a word (or sign) outside of brackets and CASE ... END."""
    out, depth, last = [], 0, 0
    sign = re.escape(word) if not word.isalpha() else rf"\b{word}\b"
    for m in re.finditer(rf"[(\[{{]|[)\]}}]|\bCASE\b|\bEND\b|{sign}", text):
        if m[0] in ("(", "[", "{", "CASE"):
            depth += 1
        elif m[0] in (")", "]", "}", "END"):
            depth -= 1
        elif depth == 0:
            out.append(text[last : m.start()])
            last = m.end()
    return [*out, text[last:]]


class Cypher:
    def __init__(self, nodes: DataFrame, edges: DataFrame) -> None:
        self.nodes, self.edges = nodes, edges
        self.texts: list[str] = []
        self.scalars: set[str] = set()
        self._optional = False
        self.props = nodes.columns

    # --- patterns
    def _node(self, var: str, label: str | None, props: str | None) -> DataFrame:
        n = self.nodes
        if label:
            n = n.where(F.col("label") == label)
        for item in filter(str.strip, (props or "").strip("{} \n").split(",")):
            m = re.fullmatch(r"\s*(\w+)\s*:\s*(\S+)\s*", item)
            if not m:
                raise ValueError(f"unknown property {item!r}")
            n = n.where(F.col(m[1]) == self._value(m[2]))
        return n.select(*[F.col(c).alias(f"{var}.{c}") for c in self.props])

    def _hops(self, types: str | None, span: str | None) -> DataFrame:
        e = self.edges.where(F.col("type").isin(re.split(r"[|:]+", types))) if types else self.edges
        e = e.select("src", "dst")
        if not span:
            return e
        m = re.fullmatch(r"\*(\d+)?(\.\.)?(\d+)?", span)
        lo = int(m[1] or 1)
        hi = int(m[3]) if m[3] else MAX_HOPS if m[2] or not m[1] else lo
        endless = not m[3] and bool(m[2] or not m[1])
        if max(lo, hi) > MAX_HOPS:
            raise ValueError(f"more than {MAX_HOPS} hops")
        step, out = e.distinct(), []
        cur = step
        longer = lambda c: c.join(step.select(F.col("src").alias("dst"), F.col("dst").alias("to")), "dst").select("src", F.col("to").alias("dst")).distinct()
        for h in range(1, hi + 1):
            if h > 1:
                cur = longer(cur)
            if h >= lo:
                out.append(cur)
        if not out:
            return step.limit(0)
        found = reduce(DataFrame.unionByName, out).distinct()
        # Pairs of walks of one more hop that are known already add nothing, nor do their continuations, if all are known.
        if endless and not longer(cur).join(found, ["src", "dst"], "left_anti").isEmpty():
            raise RuntimeError(f"paths go on after {MAX_HOPS} hops")
        return found

    def _pattern(self, text: str, rows: DataFrame | None, optional: bool, bound: list[str]) -> DataFrame:
        parts = re.match(_NODE, text)
        var = parts[1] or f"_n{len(bound)}"
        pos = parts.end()
        block, fresh = None, []
        if var not in bound:
            block = self._node(var, parts[2], parts[3])
            bound.append(var)
            fresh.append(var)
        anchor = var if not fresh else None
        while m := re.match(r"\s*" + _REL + r"\s*" + _NODE, text[pos:]):
            pos += m.end()
            back, types, span, fwd, nxt, label, props = m.groups()
            nxt = nxt or f"_n{len(bound)}"
            e = self._hops(types, span)
            a, b = ("dst", "src") if back and not fwd else ("src", "dst")
            if not back and not fwd:
                e = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
            e = e.select(F.col(a).alias(f"_a{pos}"), F.col(b).alias(f"_b{pos}"))
            known = nxt in bound
            right = e if known else e.join(self._node(nxt, label, props), F.col(f"_b{pos}") == F.col(f"`{nxt}.id`"))
            if block is None:
                block = right
                key = f"_a{pos}"
                how = "left" if optional else "inner"
                cond = F.col(f"`{anchor}.id`") == F.col(key)
                if known:
                    cond = cond & (F.col(f"_b{pos}") == F.col(f"`{nxt}.id`"))
                first = (cond, how)
            else:
                cond = F.col(f"`{var}.id`") == F.col(f"_a{pos}")
                if known:
                    cond = cond & (F.col(f"_b{pos}") == F.col(f"`{nxt}.id`"))
                block = block.join(right, cond)
            if not known:
                bound.append(nxt)
            var = nxt
        if rows is None:
            return block
        if anchor is None:
            raise ValueError("a further pattern must start at a bound variable")
        return rows.join(block, first[0], first[1])

    # --- expressions
    def _value(self, text: str) -> Column:
        text = text.strip()
        if m := re.fullmatch(r"\x00(\d+)\x00", text):
            return F.lit(self.texts[int(m[1])])
        if re.fullmatch(r"-?\d+", text):
            return F.lit(int(text))
        if re.fullmatch(r"-?\d+\.\d+", text):
            return F.lit(float(text))
        if text.upper() in ("TRUE", "FALSE", "NULL"):
            return F.lit({"TRUE": True, "FALSE": False, "NULL": None}[text.upper()])
        if m := re.fullmatch(r"CASE\s+(WHEN\b.*?)(?:\s+ELSE\s+(.*?))?\s+END", text, re.S):
            out = None
            for w in re.findall(r"WHEN\s+(.*?)\s+THEN\s+(.*?)(?=\s+WHEN\b|\s*$)", m[1], re.S):
                out = (F if out is None else out).when(self._condition(w[0]), self._value(w[1]))
            return out if m[2] is None else out.otherwise(self._value(m[2]))
        if m := re.fullmatch(r"(\w+)\.(\w+)", text):
            return F.col(f"`{m[1]}.{m[2]}`")
        if m := re.fullmatch(r"(\w+)\((.*)\)", text, re.S):
            args = [a for a in _split(m[2], ",") if a.strip()]
            return _FUNCS[m[1].lower()](*[int(a) if re.fullmatch(r"\s*\d+\s*", a) else self._value(a) for a in args])
        if re.fullmatch(r"\w+", text):
            return F.col(f"`{text}`") if text in self.scalars else F.col(f"`{text}.id`")
        raise ValueError(f"unknown expression {text!r}")

    def _condition(self, text: str) -> Column:
        text = text.strip()
        for word, op in (("OR", lambda a, b: a | b), ("XOR", lambda a, b: a != b), ("AND", lambda a, b: a & b)):
            parts = _split(text, word)
            if len(parts) > 1:
                return reduce(op, map(self._condition, parts))
        if re.match(r"NOT\b", text):
            return ~self._condition(text[3:])
        if m := re.fullmatch(r"\x01(\d+)\x01", text):
            return F.coalesce(F.col(f"_exists{m[1]}"), F.lit(False))
        if text.startswith("(") and text.endswith(")"):
            return self._condition(text[1:-1])
        if m := re.fullmatch(r"(.+?)\s+IS\s+(NOT\s+)?NULL", text):
            v = self._value(m[1])
            return v.isNotNull() if m[2] else v.isNull()
        if m := re.fullmatch(r"(.+?)\s+IN\s+\[(.*)\]", text):
            return self._value(m[1]).isin(*[self._value(x) for x in m[2].split(",")])
        for word, op in (("CONTAINS", lambda a, b: a.contains(b)), ("STARTS WITH", lambda a, b: a.startswith(b)), ("ENDS WITH", lambda a, b: a.endswith(b))):
            if f" {word} " in text:
                a, b = text.split(f" {word} ", 1)
                return op(self._value(a), self._value(b))
        m = re.fullmatch(r"(.+?)\s*(<>|<=|>=|=~|=|<|>)\s*(.+)", text, re.S)
        if not m:
            raise ValueError(f"unknown condition {text!r}")
        a, b = self._value(m[1]), self._value(m[3])
        return {"=": lambda: a == b, "<>": lambda: a != b, "<": lambda: a < b, ">": lambda: a > b, "<=": lambda: a <= b, ">=": lambda: a >= b, "=~": lambda: F.regexp_like(a, F.concat(F.lit("^(?:"), b, F.lit(")$")))}[m[2]]()

    def _where(self, rows: DataFrame, text: str) -> DataFrame:
        """Each EXISTS part becomes a flag by a join with the nodes that have such an edge; then one filter."""
        names = rows.columns
        pattern = r"EXISTS\s*\{\s*\((\w+)\)\s*" + _REL + r"\s*\(\s*\)\s*\}"
        for i, m in enumerate(re.finditer(pattern, text)):
            e = self._hops(m[3], m[4])
            key = "dst" if m[2] else "src"
            flags = e.select(F.col(key).alias(f"_x{i}")).distinct().withColumn(f"_exists{i}", F.lit(True))
            rows = rows.join(flags, F.col(f"`{m[1]}.id`") == F.col(f"_x{i}"), "left")
            text = text.replace(m[0], f"\x01{i}\x01", 1)
        return rows.where(self._condition(text)).select(*[F.col(f"`{c}`") for c in names])

    def _return(self, rows: DataFrame, text: str) -> DataFrame:
        m = re.match(r"\s*(DISTINCT\s+)?(.*?)(?:\s+ORDER\s+BY\s+(.*?))?(?:\s+SKIP\s+(\d+))?(?:\s+LIMIT\s+(\d+))?\s*$", text, re.S)
        keys, aggs = [], []
        for item in _split(m[2], ","):
            x = re.fullmatch(r"\s*(.+?)(?:\s+AS\s+(\w+))?\s*", item, re.S)
            name = x[2] or re.sub(r"\W+", "_", x[1]).strip("_")
            if a := re.fullmatch(r"(count|sum|avg|min|max|collect)\(\s*(DISTINCT\s+)?(.*)\)", x[1], re.I | re.S):
                v = F.lit(1) if a[3].strip() == "*" else self._value(a[3])
                aggs.append((F.countDistinct(v) if a[2] else _AGG[a[1].lower()](v)).alias(name))
            else:
                keys.append(self._value(x[1]).alias(name))
        out = rows.groupBy(*keys).agg(*aggs) if aggs else rows.select(*keys)
        out = out.distinct() if m[1] else out
        if m[3]:
            order = [re.fullmatch(r"\s*(\S+?)(\s+DESC|\s+ASC)?\s*", o, re.I) for o in m[3].split(",")]
            out = out.orderBy(*[F.col(o[1]).desc() if (o[2] or "").strip().upper() == "DESC" else F.col(o[1]) for o in order])
        if m[4]:
            out = out.offset(int(m[4]))
        if m[5] and int(m[5]) > MAX_ROWS:
            raise ValueError(f"LIMIT above {MAX_ROWS}")
        return out.limit(int(m[5])) if m[5] else out

    def run(self, query: str) -> DataFrame:
        self.texts, self.scalars = [], set()

        def aside(m: re.Match) -> str:
            self.texts.append(m[0][1:-1])
            return f"\x00{len(self.texts) - 1}\x00"

        query = re.sub(r"\"[^\"]*\"|'[^']*'", aside, query)
        if m := re.search(r"\b(CREATE|MERGE|DELETE|SET|REMOVE|DETACH|WITH|CALL|FOREACH|LOAD)\b", re.sub(r"\b(STARTS|ENDS)\s+WITH\b", "", query)):
            raise ValueError(f"{m[1]} is not supported")
        union = re.split(r"\bUNION(\s+ALL)?\b", query)
        out = None
        for i in range(0, len(union), 2):
            one = self._single(union[i])
            out = one if out is None else out.unionByName(one) if union[i - 1] else out.unionByName(one).distinct()
        return out

    def _single(self, query: str) -> DataFrame:
        head, tail = re.split(r"\bRETURN\b", query, maxsplit=1)
        rows, bound, self._optional = None, [], False
        clause = r"(?:OPTIONAL\s+)?MATCH\b|UNWIND\b"
        for part in re.split(rf"(?={clause})", re.sub(r"OPTIONAL\s+MATCH", "OPTIONAL_MATCH", head).replace("OPTIONAL_MATCH", "\x02MATCH")):
            optional = part.rstrip().endswith("\x02")
            part = part.replace("\x02", "").strip()
            if not part:
                self._optional = optional
                continue
            if m := re.fullmatch(r"UNWIND\s+\[(.*)\]\s+AS\s+(\w+)", part, re.S):
                base = self.nodes.sparkSession.range(1).select() if rows is None else rows
                rows = base.select("*", F.explode(F.array(*[self._value(x) for x in _split(m[1], ",")])).alias(m[2]))
                self.scalars.add(m[2])
            elif m := re.fullmatch(r"MATCH\s+(.*?)(?:\s+WHERE\s+(.*))?", part, re.S):
                rows = self._pattern(m[1].strip(), rows, self._optional, bound)
                if m[2]:
                    rows = self._where(rows, m[2])
            else:
                raise ValueError(f"unknown clause {part!r}")
            self._optional = optional
        return self._return(rows, tail)
