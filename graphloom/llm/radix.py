"""An adaptive radix tree over byte strings made of fixed-width items.

Inner nodes have four layouts by their number of children: up to 4 and up to 16 as a sorted
list of bytes beside a list of children, up to 48 through an index of 256 bytes, more as a
table of 256 children. A node moves to the next layout when it is full. A chain without
branches is one node with a label (path compression).

Items are ``width`` bytes. A byte string may end inside the tree, always between two items;
:func:`summaries` walks the tree and reports one row per prefix of whole items, also where it
lies inside a label, and nothing for the byte depths between.
"""

from __future__ import annotations

from bisect import bisect_left


class Sorted:
    """Up to ``room`` children in the order of their first bytes."""

    __slots__ = ("room", "keys", "nodes")

    def __init__(self, room: int):
        self.room, self.keys, self.nodes = room, bytearray(), []

    def get(self, byte: int):
        i = bisect_left(self.keys, byte)
        return self.nodes[i] if i < len(self.keys) and self.keys[i] == byte else None

    def put(self, byte: int, node) -> bool:
        """False when there is no room."""
        i = bisect_left(self.keys, byte)
        if i < len(self.keys) and self.keys[i] == byte:
            self.nodes[i] = node
            return True
        if len(self.keys) == self.room:
            return False
        self.keys.insert(i, byte)
        self.nodes.insert(i, node)
        return True

    def pairs(self) -> list:
        return list(zip(self.keys, self.nodes))


class Indexed:
    """Up to 48 children behind an index by byte."""

    __slots__ = ("index", "nodes")
    room = 48

    def __init__(self):
        self.index, self.nodes = bytearray(256), []

    def get(self, byte: int):
        return self.nodes[self.index[byte] - 1] if self.index[byte] else None

    def put(self, byte: int, node) -> bool:
        if self.index[byte]:
            self.nodes[self.index[byte] - 1] = node
        elif len(self.nodes) == self.room:
            return False
        else:
            self.nodes.append(node)
            self.index[byte] = len(self.nodes)
        return True

    def pairs(self) -> list:
        return [(b, self.nodes[i - 1]) for b, i in enumerate(self.index) if i]


class Direct:
    """A place for each of the 256 bytes."""

    __slots__ = ("nodes",)
    room = 256

    def __init__(self):
        self.nodes = [None] * 256

    def get(self, byte: int):
        return self.nodes[byte]

    def put(self, byte: int, node) -> bool:
        self.nodes[byte] = node
        return True

    def pairs(self) -> list:
        return [(b, node) for b, node in enumerate(self.nodes) if node is not None]


#: The layout after each one.
NEXT = {4: lambda: Sorted(16), 16: Indexed, 48: Direct}


class Node:
    __slots__ = ("label", "children", "ends")

    def __init__(self, label: bytes):
        self.label = label
        self.children = None
        self.ends = None  # what is stored for the string that ends here

    def child(self, byte: int):
        return None if self.children is None else self.children.get(byte)

    def adopt(self, node: "Node") -> None:
        if self.children is None:
            self.children = Sorted(4)
        if not self.children.put(node.label[0], node):
            larger = NEXT[self.children.room]()
            for byte, other in self.children.pairs():
                larger.put(byte, other)
            larger.put(node.label[0], node)
            self.children = larger

    def pairs(self) -> list:
        return [] if self.children is None else self.children.pairs()


def shared(a: bytes, b: bytes) -> int:
    """How many first bytes are equal."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n - 1  # the first difference is at low or later, at high or before
    while low < high:
        mid = (low + high) // 2
        if a[low:mid + 1] == b[low:mid + 1]:
            low = mid + 1
        else:
            high = mid
    return low


class RadixTree:
    def __init__(self):
        self.root = Node(b"")

    def insert(self, key: bytes, ends) -> None:
        node, at = self.root, 0
        while True:
            if at == len(key):
                node.ends = ends
                return
            below = node.child(key[at])
            if below is None:
                leaf = Node(key[at:])
                leaf.ends = ends
                node.adopt(leaf)
                return
            label = below.label
            here = key[at:at + len(label)]
            if here != label:
                n = shared(here, label)
                middle = Node(label[:n])
                below.label = label[n:]
                middle.adopt(below)
                node.adopt(middle)
                below = middle
                here = label[:n]
            node, at = below, at + len(here)

    def walk(self, key: bytes) -> list[Node]:
        """The nodes on the way to an inserted string."""
        node, at, way = self.root, 0, [self.root]
        while at < len(key):
            node = node.child(key[at])
            at += len(node.label)
            way.append(node)
        return way


def summaries(tree: RadixTree, width: int, amount, begins, goes_on):
    """One row per prefix of whole items, children before parents.

    A stored string ends with ``(count, least)``. ``amount(item)`` is a number that every
    string below a prefix has for the prefix's last item. Rows are lists of item depth, ends
    or None, count, least, children, leaves, total, the row number of the parent, and whether the
    prefix is new: count and least of the strings below, the new prefixes one item longer, the
    prefixes below that nothing continues, and the sum over prefixes below of amount times
    count, less one amount for each new prefix. ``begins(node, depth)`` says whether a prefix counts as
    new, ``goes_on(node, depth)`` whether strings outside this tree may continue it.
    """
    rows: list[list] = []
    # Post-order without recursion: a conversation may be longer than the stack is deep.
    stack = [(tree.root, 0, b"", None, None)]
    while stack:
        node, start, tail, state, above = stack.pop()  # tail: the part of an item before the label
        stop = start + len(node.label)
        if state is None:
            state = [0, None, 0, 0, []]  # count, least, leaves, total, prefixes just below
            stack.append((node, start, tail, state, above))
            rest = stop % width
            after = (tail + node.label)[-rest:] if rest else b""
            for _, child in reversed(node.pairs()):
                stack.append((child, stop, after, None, state))
            continue
        count, least, leaves, total, below = state
        ends = node.ends
        if ends is not None:
            count += ends[0]
            least = ends[1] if least is None else min(least, ends[1])
        depth = stop // width
        # The root itself is the prefix of no items.
        while depth * width > start or node is tree.root and depth == 0:
            at = depth * width - start
            item = node.label[at - width:at] if at >= width else tail + node.label[:at]
            new = begins(node, depth)
            size = amount(item) if depth else 0
            total += size * count - (size if new else 0)
            last = depth * width == stop
            if not below and not goes_on(node, depth):
                leaves += 1
            number = len(rows)
            rows.append([depth, ends if last else None, count, least,
                         sum(rows[i][8] for i in below), leaves, total, None, int(new)])
            for i in below:
                rows[i][7] = number
            below = [number]
            depth -= 1
        if above is not None:
            above[0] += count
            if least is not None:
                above[1] = least if above[1] is None else min(above[1], least)
            above[2] += leaves
            above[3] += total
            above[4] += below
    return rows
