"""Rule extraction: lexical pairs from alignments, and phrase pairs from derivation trees."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lexical_pairs(corpus: DataFrame, align: DataFrame) -> DataFrame:
    """Every aligned source word with its target words, joined in the order of the alignment: sent_id, ord, src, tgt, l, r."""
    words = corpus.select("sent_id", F.col("src").alias("sw"), F.col("tgt").alias("tw"))
    linked = align.join(words, "sent_id").where((F.col("s") < F.size("sw")) & (F.col("t") < F.size("tw")))
    picked = linked.select("sent_id", "s", "ord", F.element_at("sw", F.col("s") + 1).alias("src"), F.element_at("tw", F.col("t") + 1).alias("word"))
    joined = picked.groupBy("sent_id", "s", "src").agg(F.array_sort(F.collect_list(F.struct("ord", "word"))).alias("w"))
    return joined.select("sent_id", F.col("s").alias("ord"), "src", F.array_join(F.col("w.word"), " ").alias("tgt"), F.col("s").alias("l"), F.col("s").alias("r"))


@dataclass
class Node:
    """A tree node: ``parts`` are source positions (from 0) and child nodes, in order."""

    parts: list[int | Node] = field(default_factory=list)

    def lexical(self) -> bool:
        return any(isinstance(p, int) for p in self.parts)

    def positions(self) -> list[int]:
        out: list[int] = []
        todo: list[int | Node] = [self]
        while todo:
            p = todo.pop()
            if isinstance(p, int):
                out.append(p)
            else:
                todo.extend(reversed(p.parts))
        return out


def matching_bracket(text: str, start: int = 0) -> int:
    """Index of the bracket that closes the one at ``start``; -1 if none does."""
    depth = 0
    for i in range(start, len(text)):
        depth += (text[i] == "(") - (text[i] == ")")
        if depth == 0 and text[i] == ")":
            return i
    return -1


def parse_tree(text: str) -> Node | None:
    """Reads ``(1 (2 3 ) )``; leaves count source words from 1. None for text without a bracket, ValueError if unbalanced."""
    stack: list[Node] = []
    root: Node | None = None
    for word in text.replace("(", " ( ").replace(")", " ) ").split():
        if word == "(":
            node = Node()
            if stack:
                stack[-1].parts.append(node)
            elif root is not None:
                raise ValueError("more than one tree")
            else:
                root = node
            stack.append(node)
        elif not stack:
            raise ValueError("text outside of brackets")
        elif word == ")":
            stack.pop()
        elif word.isdigit():
            stack[-1].parts.append(int(word) - 1)
    if stack:
        raise ValueError("a bracket isn't closed")
    return root


def tree_phrases(text: str, src: list[str], tgt: list[str], links: list[tuple[int, int]], max_length: int = 5) -> list[dict]:
    """Phrase pairs of a derivation tree in pre-order: those of nodes with a word of their own and at most ``max_length`` source words.

    A node spans its smallest to largest position; its target side is the whole stretch between the smallest and the
    largest target word aligned to it, unaligned words included. ``rule`` and ``tgt_rule`` have ``[X]`` for children, on
    the target side where the child's own stretch begins. Nodes without an aligned word give nothing.
    """
    to: dict[int, list[int]] = {}
    for s, t in links:
        to.setdefault(s, []).append(t)

    def stretch(node: Node) -> tuple[int, int] | None:
        hit = [t for p in node.positions() for t in to.get(p, ())]
        return (min(hit), max(hit)) if hit else None

    out: list[dict] = []
    root = parse_tree(text)
    todo = [root] if root else []
    while todo:
        node = todo.pop()
        todo.extend(reversed([p for p in node.parts if isinstance(p, Node)]))
        where, span = node.positions(), stretch(node)
        if not where or span is None or not node.lexical() or max(where) - min(where) + 1 > max_length:
            continue
        marks: set[tuple[int, str]] = set()
        for p in node.parts:
            if isinstance(p, int):
                marks |= {(t, tgt[t]) for t in to.get(p, ())}
            elif (child := stretch(p)) is not None:
                marks.add((child[0], "[X]"))
        out.append(
            {
                "src": " ".join(src[p] for p in where),
                "tgt": " ".join(tgt[span[0] : span[1] + 1]),
                "rule": " ".join(src[p] if isinstance(p, int) else "[X]" for p in node.parts),
                "tgt_rule": " ".join(w for _, w in sorted(marks)),
                "l": min(where),
                "r": max(where),
            }
        )
    return out


PHRASES = "sent_id long, ord int, src string, tgt string, rule string, tgt_rule string, l int, r int"


def tree_pairs(trees: DataFrame, max_length: int = 5) -> DataFrame:
    """Phrase pairs of ``trees(sent_id, sexp, src, tgt, links array<struct<s,t>>)``; rows are handled in Arrow batches."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            rows = []
            for r in b.to_pylist():
                links = [(x["s"], x["t"]) for x in r["links"] or ()]
                for k, p in enumerate(tree_phrases(r["sexp"] or "", r["src"] or [], r["tgt"] or [], links, max_length)):
                    rows.append({"sent_id": r["sent_id"], "ord": k, **p})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("sent_id", pa.int64()), ("ord", pa.int32()), *[(c, pa.string()) for c in ("src", "tgt", "rule", "tgt_rule")], ("l", pa.int32()), ("r", pa.int32())]))

    return trees.select("sent_id", "sexp", "src", "tgt", "links").mapInArrow(run, PHRASES)
