"""A serial merge of one file's catalogs, against which the joins are tested."""

from difflib import SequenceMatcher

from textloom.functions import text as T
from textloom.operators.match import LEAST_SHAPE_RATIO, Entry, payload_of, score, taken


def merge_file(news: list[Entry], olds: list[Entry]) -> tuple[list[tuple[Entry, str]], list[Entry]]:
    """(entries of the new file with their status, old entries to archive)."""
    index: list[dict] = [{}, {}, {}, {}]
    for i, old in enumerate(olds):
        for tier, key in enumerate(old.tiers):
            if key or tier < 2:
                index[tier].setdefault(key, []).append(i)
    used: set[int] = set()
    blank = lambda i: (not olds[i].translation, olds[i].stage == T.HIDDEN_STAGE)

    def similar(new: Entry) -> list[int]:
        p = payload_of(new.context)
        if not p or p.get("kind") != "line-template" or not p.get("source") or not new.template or not new.shape:
            return []
        best, top = [], 0.0
        for (shape, n), members in index[3].items():
            free = [i for i in members if i not in used]
            if free and n == len(new.template[1]):
                pair = SequenceMatcher(None, new.shape[0], shape)
                able = all(bound() >= LEAST_SHAPE_RATIO for bound in (pair.real_quick_ratio, pair.quick_ratio))
                if able and (s := pair.ratio()) >= LEAST_SHAPE_RATIO and s > top:
                    best, top = free, s
        return [min(best, key=lambda i: (*blank(i), best.index(i)))] if best else []

    merged: list[tuple[Entry, str]] = []
    for new in news:
        ranks = []
        for tier, key in enumerate(new.tiers):
            found = index[tier].get(key, []) if key or tier < 2 else []
            ranks += [(blank(i)[0], tier, blank(i)[1], place, i) for place, i in enumerate(found) if i not in used]
        ranks += [(blank(i)[0], 4, blank(i)[1], 0, i) for i in similar(new)]
        pick = min(ranks)[-1] if ranks else None
        if pick is not None:
            used.add(pick)
        merged.append((taken(olds[pick], new), "migrated") if pick is not None and olds[pick].translation else (new, "new"))
    for i, old in enumerate(olds):
        if i in used or not old.translation or not old.fuzzy:
            continue
        scored = [(s, -slot) for slot, (new, status) in enumerate(merged) if status == "new" and old.kind == new.kind and new.fuzzy and (s := score(old, new)) is not None]
        if scored:
            slot = -max(scored)[1]
            merged[slot] = (taken(old, merged[slot][0]), "migrated")
            used.add(i)
    there = [{e.tiers[tier] for e, _ in merged} - {None} for tier in range(4)]
    gone = [o for i, o in enumerate(olds) if i not in used and o.extractable() and not any(k is not None and k in there[t] for t, k in enumerate(o.tiers))]
    return merged, gone
