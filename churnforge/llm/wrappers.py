"""Wrappers: union-free regular expressions over the token streams of a host's pages.

A wrapper is a list of items: text slots, elements with the wrapper of what they hold, and groups (sequences that repeat).
An item may be optional or repeated; there are no alternatives. Two wrappers are aligned item by item: items that only one
of them has become optional, sequences that follow each other in equal form become one repeated group, texts become slots.
A list beyond a bound becomes one repeated group of optional items, which every sequence of these items fits, so that a
wrapper's size follows its alphabet and not the number of pages.
"""

from __future__ import annotations

import json
from functools import lru_cache

import xxhash

from churnforge.llm.pagetree import FURNITURE, HEADINGS, Element

LIST_MAX = 64                   #: items of a list before it becomes one repeated group of optional items
PERIOD_MAX = 4                  #: items of a repeated group
#: Tiers of slots: inside an article, inside the main part, inside a named content part, in the region with most text.
ARTICLE, MAIN, CONTENT, REGION, OTHER = 1, 2, 3, 4, 9
SHARE = 0.7                     #: share of a region's text that one child must hold to become the region
CONTAINERS = frozenset("html body div section center table tbody tr td".split())
CONSTANT_PAGES = 3              #: pages from which a text that is the same on all of them counts as part of the template


class Item:
    """Text slot (body None), element, or group (key begins with a bracket). `stat` of a slot: pages, characters,
    characters in links, smallest and largest hash of its text on a page. `runs`: a page's own text runs."""

    __slots__ = ("body", "key", "opt", "plus", "runs", "stat")

    def __init__(self, key: str, body: list[Item] | None, stat: list[int] | None = None, runs: list[Element] | None = None,
                 opt: bool = False, plus: bool = False):
        self.key, self.body, self.stat, self.runs, self.opt, self.plus = key, body, stat, runs or [], opt, plus


def _merge(a: Item, b: Item, pages: bool) -> Item:
    """One item for two of the same key; a is used up."""
    a.opt, a.plus = a.opt or b.opt, a.plus or b.plus
    if a.body is None:
        s, t = a.stat, b.stat
        a.stat = [s[0] + t[0] if pages else max(s[0], t[0]), s[1] + t[1], s[2] + t[2], min(s[3], t[3]), max(s[4], t[4])]
    else:
        a.body = align(a.body, b.body, pages)
    a.runs.extend(b.runs)
    return a


def _any_order(items: list[Item], pages: bool) -> list[Item]:
    """One repeated group of optional items, one of each key."""
    found: dict[str, Item] = {}
    for item in items:
        for x in item.body if item.key == "(*)" else [item]:
            x.opt = True
            found[x.key] = _merge(found[x.key], x, pages) if x.key in found else x
    return [Item("(*)", [found[k] for k in sorted(found)], plus=True)]


def _form(x: Item) -> str:
    """What items must share to repeat: their key, and for containers the keys of what they hold as well."""
    return f"{x.key}[{','.join(y.key for y in x.body)}]" if _split(x.key)[0] in CONTAINERS else x.key


def _alike(x: Item, y: Item) -> float:
    """0 for items that cannot be aligned, else 1 and the share of keys that both hold."""
    if x.key != y.key:
        return 0.0
    if not x.body or not y.body:
        return 2.0 if bool(x.body) == bool(y.body) else 1.0
    a, b = {z.key for z in x.body}, {z.key for z in y.body}
    return 1 + len(a & b) / len(a | b)


def fold(items: list[Item]) -> list[Item]:
    """Sequences of 1 to PERIOD_MAX items that follow each other in equal form become one repeated item or group."""
    for period in range(1, PERIOD_MAX + 1):
        out, k, keys = [], 0, [_form(x) for x in items]
        while k < len(items):
            times = 1
            form = keys[k:k + period]
            if period == 1 or len(set(form)) > 1:
                while keys[k + times * period:k + (times + 1) * period] == form:
                    times += 1
            if times == 1:
                out.append(items[k])
                k += 1
                continue
            held = items[k:k + period]
            for j in range(1, times):
                held = [_merge(x, y, False) for x, y in zip(held, items[k + j * period:k + (j + 1) * period], strict=True)]
            if period == 1:
                held[0].plus = True
                out.append(held[0])
            else:
                out.append(Item("(" + " ".join(x.key for x in held) + ")", held, plus=True))
            k += times * period
        items = out
    return items if len(items) <= LIST_MAX else _any_order(items, False)


def _bracket(items: list[Item], other: list[Item]) -> list[Item]:
    """Where `other` repeats a group, a sequence of the same form in `items` becomes a group too."""
    for group in other:
        if not group.key.startswith("(") or group.key == "(*)" or any(x.key == group.key for x in items):
            continue
        form = [x.key for x in group.body]
        for k in range(len(items) - len(form) + 1):
            if [x.key for x in items[k:k + len(form)]] == form:
                items = [*items[:k], Item(group.key, items[k:k + len(form)]), *items[k + len(form):]]
                break
    return items


def _pairs(a: list[Item], b: list[Item]) -> list[tuple[int, int]]:
    """The alignment of two lists in which the items met are most alike."""
    like = [[_alike(x, y) for y in b] for x in a]
    best = [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            met = best[i + 1][j + 1] + like[i][j] if like[i][j] else 0.0
            best[i][j] = max(met, best[i + 1][j], best[i][j + 1])
    i = j = 0
    out = []
    while i < len(a) and j < len(b):
        if like[i][j] and best[i][j] == best[i + 1][j + 1] + like[i][j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def align(a: list[Item], b: list[Item], pages: bool) -> list[Item]:
    """The items of both in one list; what only one of them has becomes optional. Both are used up."""
    if (a and a[0].key == "(*)") or (b and b[0].key == "(*)"):
        return _any_order([*a, *b], pages)
    a, b = _bracket(a, b), _bracket(b, a)
    keys_a, keys_b = [x.key for x in a], [x.key for x in b]
    if keys_a == keys_b:
        return [_merge(x, y, pages) for x, y in zip(a, b, strict=True)]
    out, i, j = [], 0, 0
    for to_i, to_j in [*_pairs(a, b), (len(a), len(b))]:
        for x in (*a[i:to_i], *b[j:to_j]):
            x.opt = True
            out.append(x)
        if to_i < len(a):
            out.append(_merge(a[to_i], b[to_j], pages))
        i, j = to_i + 1, to_j + 1
    return out if len(out) <= LIST_MAX else _any_order(out, pages)


def page_items(node: Element) -> list[Item]:
    """A page's own wrapper: its elements with repetitions folded."""
    items = []
    for child in node.children:
        if child.children is None:
            mark = xxhash.xxh64_intdigest(child.text.encode("utf-8", "surrogatepass")) >> 1
            items.append(Item("T", None, [1, len(child.text), child.links, mark, mark], [child]))
        else:
            items.append(Item(child.key, page_items(child)))
    return fold(items)


def slots(items: list[Item]) -> list[Item]:
    out = []
    for x in items:
        out += [x] if x.body is None else slots(x.body)
    return out


def _plain(items: list[Item]) -> list:
    return [[x.key, x.opt + 2 * x.plus, None if x.body is None else _plain(x.body)] for x in items]


def dump(items: list[Item]) -> str:
    """The expression without the statistics of its slots."""
    return json.dumps(_plain(items), separators=(",", ":"))


def load(text: str, stats: list[list[int]]) -> list[Item]:
    """The expression with the statistics of its slots, in the order of the slots."""
    left = iter(stats)

    def build(plain: list) -> list[Item]:
        return [Item(key, None if body is None else build(body), list(next(left)) if body is None else None,
                     opt=bool(flags & 1), plus=bool(flags & 2)) for key, flags, body in plain]

    return build(json.loads(text))


def _split(key: str) -> tuple[str, str]:
    name, _, part = key.partition(".")
    return name, part


def _holds_text(item: Item) -> bool:
    """Whether an article or main part stands in the element."""
    return item.body is not None and any(_split(x.key)[1] in ("article", "main") or _holds_text(x) for x in item.body)


def annotate(items: list[Item]) -> list[int]:
    """The tier of every slot (OTHER: not main text), in the order of the slots."""
    every = slots(items)
    most = max((x.stat[0] for x in every), default=0)
    varied = {id(x) for x in every if x.stat[0] < CONSTANT_PAGES or x.stat[3] != x.stat[4]}
    if not varied:
        varied = {id(x) for x in every}                     # all pages are the same: nothing tells template from text
    tiers: dict[int, int] = {}

    def walk(some: list[Item], tier: int, headings: bool) -> None:
        """`headings`: in a header inside the text, of which only headings belong to it."""
        for x in some:
            name, part = _split(x.key)
            if x.body is None:
                tiers[id(x)] = OTHER + 1 if headings else tier
            elif x.key.startswith("("):
                walk(x.body, tier, headings)
            elif part == "header" and tier <= CONTENT:
                walk(x.body, tier, True)
            elif part in FURNITURE and not _holds_text(x):
                walk(x.body, OTHER + 1, False)
            else:
                to = {"article": ARTICLE, "main": MAIN, "content": CONTENT}.get(part, tier)
                walk(x.body, min(tier, to) if tier <= OTHER else tier, headings and name not in HEADINGS)

    walk(items, OTHER, False)

    def mass(x: Item) -> int:
        if x.body is not None:
            return sum(map(mass, x.body))
        return x.stat[1] - x.stat[2] if tiers[id(x)] == OTHER and id(x) in varied else 0

    def furniture(x: Item) -> bool:
        return x.body is not None and _split(x.key)[1] in FURNITURE and not _holds_text(x)

    region, total = items, sum(map(mass, items))
    while total:
        largest = max((x for x in region if _split(x.key)[0] in CONTAINERS and not x.plus and not furniture(x)), key=mass,
                      default=None)
        if largest is None or mass(largest) < SHARE * total:
            break
        region, total = largest.body, mass(largest)

    def take(some: list[Item], name: str) -> None:
        for x in some:
            if x.body is not None:
                if not furniture(x):
                    take(x.body, name if x.key.startswith("(") else _split(x.key)[0])
            elif tiers[id(x)] == OTHER and id(x) in varied and (x.stat[2] * 2 < x.stat[1] or name in HEADINGS):
                tiers[id(x)] = REGION

    if most:
        take(region, "")
    return [min(tiers[id(x)], OTHER) for x in every]


@lru_cache(maxsize=256)
def _annotated(text: str, stats: str) -> list[Item]:
    """The wrapper with the tier of every slot in place of its statistics."""
    wrapper = load(text, json.loads(stats))
    for x, tier in zip(slots(wrapper), annotate(wrapper), strict=True):
        x.stat = [tier]
    return wrapper


def label_page(items: list[Item], text: str, stats: str) -> None:
    """Align a page with its host's wrapper (given as `dump` and statistics) and set the tier of its text runs."""
    _label(_annotated(text, stats), items)


def _label(wrapper: list[Item], items: list[Item]) -> None:
    if any(x.key == "(*)" for x in (*wrapper[:1], *items[:1])):
        known = {y.key: y for x in wrapper for y in (x.body if x.key == "(*)" else [x])}
        pairs = [(known.get(y.key), y) for x in items for y in (x.body if x.key == "(*)" else [x])]
    else:
        items = _bracket(items, wrapper)
        wrapper = _bracket(wrapper, items)
        keys_w, keys_i = [x.key for x in wrapper], [x.key for x in items]
        if keys_w == keys_i:
            pairs = list(zip(wrapper, items, strict=True))
        else:
            met = {j: wrapper[i] for i, j in _pairs(wrapper, items)}
            first = {x.key: x for x in reversed(wrapper)}
            pairs = [(met.get(j) or first.get(y.key), y) for j, y in enumerate(items)]
    for x, y in pairs:
        if x is None:
            continue
        if y.body is None:
            for run in y.runs:
                run.tier = x.stat[0]
        else:
            _label(x.body, y.body)
