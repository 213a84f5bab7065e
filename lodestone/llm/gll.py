"""Generalised LL recognition with a graph-structured stack, over rules with regular right parts.

A grammar is text: ``Name = body`` with 'terminals', Nonterminals (capital), macros (lower case,
expanded in place, not recursive), juxtaposition, ``|``, ``( )``, ``? * +``; ``EOS`` holds before a
token that starts a line and at the end, ``!'t'`` holds before a token that is not ``t``. Each rule
becomes a deterministic automaton over its symbols, so a run forks only where two nonterminals, or
a nonterminal and a terminal, can start with the same token.

A token is the number of a class, and a class is a set of terminals: that is how a bracketed group,
recognised on its own, counts as several things at once (a block, an object, a class body) until its
surroundings decide.
"""

from __future__ import annotations

import re

_SYMBOL = re.compile(r"\s*(?:(!?'[^']+')|([A-Za-z_]\w*)|([()|?*+]))")
LINE_START = "<line start>"


class Grammar:
    def __init__(self, text: str):
        self.bodies: dict[str, str] = {}
        name = ""
        for line in text.splitlines():
            if m := re.match(r"(\w+) = (.*)", line):
                name = m.group(1)
                self.bodies[name] = m.group(2)
            elif line.strip():
                self.bodies[name] += " " + line.strip()
        self.edges: list[dict[tuple[str, str], int]] = []
        self.accepts: list[bool] = []
        self.start: dict[str, int] = {}
        for name in self.bodies:
            if name[0].isupper():
                self._compile(name)
        self._first_sets()
        self.classes: list[frozenset[str]] = []
        self.class_of: dict[frozenset[str], int] = {}
        self.actions: list[dict[int, tuple]] = [{} for _ in self.edges]
        self.end = self.cls(frozenset([LINE_START, "<end>"]))

    # rule text -> nondeterministic automaton -> deterministic automaton

    def _compile(self, name: str) -> None:
        moves: list[dict[tuple[str, str] | None, list[int]]] = []

        def state() -> int:
            moves.append({})
            return len(moves) - 1

        def link(a: int, label: tuple[str, str] | None, b: int) -> None:
            moves[a].setdefault(label, []).append(b)

        def parse(body: str) -> tuple[int, int]:
            tokens = [m.groups() for m in _SYMBOL.finditer(body)]
            at = 0

            def alternatives() -> tuple[int, int]:
                nonlocal at
                first, last = state(), state()
                while True:
                    a, b = sequence()
                    link(first, None, a)
                    link(b, None, last)
                    if at < len(tokens) and tokens[at][2] == "|":
                        at += 1
                        continue
                    return first, last

            def sequence() -> tuple[int, int]:
                nonlocal at
                first = last = state()
                while at < len(tokens) and tokens[at][2] not in ("|", ")"):
                    terminal, word, mark = tokens[at]
                    at += 1
                    if mark == "(":
                        a, b = alternatives()
                        at += 1
                    elif word and word != "EOS" and not word[0].isupper():
                        a, b = parse(self.bodies[word])
                    else:
                        a, b = state(), state()
                        label = ("eos", "") if word == "EOS" else ("n", word) if word else ("not", terminal[2:-1]) if terminal[0] == "!" else ("t", terminal[1:-1])
                        link(a, label, b)
                    while at < len(tokens) and tokens[at][2] in ("?", "*", "+"):
                        mark = tokens[at][2]
                        at += 1
                        x, y = state(), state()
                        link(x, None, a)
                        link(b, None, y)
                        if mark in "?*":
                            link(x, None, y)
                        if mark in "*+":
                            link(b, None, a)
                        a, b = x, y
                    link(last, None, a)
                    last = b
                return first, last

            return alternatives()

        first, last = parse(self.bodies[name])

        # of the states that a state reaches without a symbol, those with a symbol of their own and the last one tell sets apart
        reached: dict[int, frozenset[int]] = {}
        closures: dict[frozenset[int], frozenset[int]] = {}

        def reach(state: int) -> frozenset[int]:
            if state not in reached:
                seen, todo = {state}, [state]
                while todo:
                    for b in moves[todo.pop()].get(None, ()):
                        if b not in seen:
                            seen.add(b)
                            todo.append(b)
                reached[state] = frozenset(s for s in seen if s == last or moves[s].keys() - {None})
            return reached[state]

        def closure(states: frozenset[int]) -> frozenset[int]:
            if states not in closures:
                closures[states] = frozenset().union(*map(reach, states))
            return closures[states]

        numbers: dict[frozenset[int], int] = {}
        todo = []

        def number(states: frozenset[int]) -> int:
            if states not in numbers:
                numbers[states] = len(self.edges)
                self.edges.append({})
                self.accepts.append(last in states)
                todo.append(states)
            return numbers[states]

        self.start[name] = number(closure(frozenset([first])))
        while todo:
            states = todo.pop()
            onward: dict[tuple[str, str], set[int]] = {}
            for s in states:
                for label, targets in moves[s].items():
                    if label is not None:
                        onward.setdefault(label, set()).update(targets)
            for label, targets in onward.items():
                self.edges[numbers[states]][label] = number(closure(frozenset(targets)))

    def _first_sets(self) -> None:
        n = len(self.edges)
        first: list[set[str]] = [set() for _ in range(n)]
        empty = list(self.accepts)
        changed = True
        while changed:
            changed = False
            for s in range(n):
                for (kind, name), to in self.edges[s].items():
                    add: set[str] = set()
                    passes = False
                    if kind == "t":
                        add = {name}
                    elif kind == "n":
                        callee = self.start[name]
                        add = set(first[callee])
                        passes = empty[callee]
                    else:
                        passes = True
                    if passes:
                        add |= first[to]
                        if empty[to] and not empty[s]:
                            empty[s] = changed = True
                    if not add <= first[s]:
                        first[s] |= add
                        changed = True
        self.first, self.empty = first, empty

    def cls(self, terms: frozenset[str]) -> int:
        number = self.class_of.get(terms)
        if number is None:
            number = self.class_of[terms] = len(self.classes)
            self.classes.append(terms)
        return number

    def _act(self, state: int, token: int) -> tuple:
        """What a state does at a token: states behind it, states before it, calls, whether it may end."""
        terms = self.classes[token]
        steps, stays, calls = [], [], []
        for (kind, name), to in self.edges[state].items():
            if kind == "t":
                if name in terms:
                    steps.append(to)
            elif kind == "n":
                callee = self.start[name]
                if self.empty[callee] or not self.first[callee].isdisjoint(terms):
                    calls.append((callee, to))
            elif kind == "eos":
                if LINE_START in terms:
                    stays.append(to)
            elif name not in terms:
                stays.append(to)
        action = (tuple(dict.fromkeys(steps)), tuple(stays), tuple(calls), self.accepts[state])
        self.actions[state][token] = action
        return action

    def recognise(self, names: tuple[str, ...], tokens: tuple[int, ...]) -> frozenset[str]:
        """Those of ``names`` that derive exactly ``tokens``; all start together on one stack graph."""
        line = (*tokens, self.end)
        size = len(tokens)
        actions = self.actions
        node_of: dict[tuple[int, int], int] = {}
        backs: list[list[tuple[int, int]]] = []
        ends: list[set[int]] = []
        done: set[str] = set()
        seen: set[tuple[int, int, int]] = set()
        todo: list[tuple[int, int, int]] = []
        roots: dict[int, str] = {}
        for name in names:
            node = len(backs)
            backs.append([])
            ends.append(set())
            roots[node] = name
            node_of.setdefault((self.start[name], 0), node)
            todo.append((self.start[name], node, 0))
        while todo:
            state, node, at = todo.pop()
            while True:
                token = line[at]
                action = actions[state].get(token)
                if action is None:
                    action = self._act(state, token)
                steps, stays, calls, ends_here = action
                onward = None
                if ends_here and at not in ends[node]:
                    ends[node].add(at)
                    if node in roots and at == size:
                        done.add(roots[node])
                    for back, parent in backs[node]:
                        item = (back, parent, at)
                        if item not in seen:
                            seen.add(item)
                            if onward is None:
                                onward = item
                            else:
                                todo.append(item)
                for callee, back in calls:
                    key = (callee, at)
                    callee_node = node_of.get(key)
                    if callee_node is None:
                        callee_node = node_of[key] = len(backs)
                        backs.append([(back, node)])
                        ends.append(set())
                        item = (callee, callee_node, at)
                        if onward is None:
                            onward = item
                        else:
                            todo.append(item)
                    else:
                        edge = (back, node)
                        if edge not in backs[callee_node]:
                            backs[callee_node].append(edge)
                            for end in ends[callee_node]:
                                item = (back, node, end)
                                if item not in seen:
                                    seen.add(item)
                                    todo.append(item)
                for to in stays:
                    item = (to, node, at)
                    if item not in seen:
                        seen.add(item)
                        todo.append(item)
                for to in steps:
                    item = (to, node, at + 1)
                    if onward is None:
                        onward = item
                    elif item not in seen:
                        seen.add(item)
                        todo.append(item)
                if onward is None:
                    break
                state, node, at = onward
        return frozenset(done)
