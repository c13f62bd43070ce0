"""Plain loops that operators are held against."""

import random
import re

_TOKEN = re.compile(r'"(?:[^"\\\n]|\\.)*"|[{}]')
_COMMA = re.compile(r'("(?:[^"\\\n]|\\.)*")|,\s*([}\]])')


def outermost_objects(text):
    """Outermost pairs of braces, strings skipped inside braces, without trailing commas outside strings."""
    opened, pairs, at = [], [], text.find("{")
    while at >= 0:
        found = _TOKEN.search(text, at)
        if found is None:
            break
        at = found.end()
        if found[0] == "{":
            opened.append(found.start())
        elif found[0] == "}" and opened:
            start = opened.pop()
            pairs = [p for p in pairs if p[0] < start] + [(start, at)]
        if not opened:
            at = text.find("{", at)
    return [_COMMA.sub(lambda m: m[1] or m[2], text[a:b]) for a, b in pairs]


def best_fit_blocks(lengths, max_len):
    """Block and place of each length, in order: where it leaves the least room, of equal ones the first."""
    free, out = [], []
    for n in lengths:
        fits = [(room, k) for k, room in enumerate(free) if room >= n]
        k = min(fits)[1] if fits else len(free)
        if not fits:
            free.append(max_len)
        out.append((k, max_len - free[k]))
        free[k] -= n
    return out


def real_path(path, links, cwd):
    """A path through links, name by name; ``LookupError`` names the link of a circle."""

    def walk(done, names, reading):
        for name in names:
            if name in ("", "."):
                continue
            if name == "..":
                done = done[:-1]
                continue
            here = "/" + "/".join([*done, name])
            if here not in links:
                done = [*done, name]
                continue
            if here in reading:
                raise LookupError(here)
            target = links[here]
            done = walk([] if target.startswith("/") else done, target.split("/"), {*reading, here})
        return done

    return "/" + "/".join(walk([], (path if path.startswith("/") else f"{cwd}/{path}").split("/"), set()))


def random_tree(seed, names="abc", depth=3):
    """Random links among a few names, circles among them, and paths over them."""
    pick = random.Random(seed)

    def path(most):
        return "/".join(pick.choice([*names, "..", "."]) for _ in range(pick.randint(1, most)))

    links = {}
    for _ in range(5):
        place = "/" + "/".join(pick.choice(names) for _ in range(pick.randint(1, depth)))
        # A link stands in a folder, not below another link.
        if not any(place.startswith(f"{p}/") or p.startswith(f"{place}/") for p in links):
            links[place] = pick.choice(["", "/"]) + path(depth)
    return links, sorted({pick.choice(["", "/"]) + path(5) for _ in range(60)})
