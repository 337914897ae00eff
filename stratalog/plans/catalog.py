"""Branches: ancestry, replay scopes, divergence.  Arithmetic over a small catalog; no log is read."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, replace
from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession

from ..errors import BranchExistsError, BranchNotFoundError, InvalidArgumentError, InvalidBranchAncestryError
from ..limits import BRANCH_NAME_BYTES, LINEAGE_NODES, name

ROOT = "main"
SCHEMA = "id string, name string, parent string, fork_position long, created_at long, status string"


@dataclass(frozen=True)
class Branch:
    id: str
    name: str
    parent: str | None = None
    fork_position: int | None = None
    created_at: int = 0
    status: str = "active"
    metadata: dict[str, bytes] = field(default_factory=dict, hash=False, compare=False)


class Catalog:
    """Branches by id; the root is there from the start."""

    def __init__(self, branches: Iterable[Branch] = (), root_id: str = ROOT):
        self.root = Branch(root_id, ROOT)
        self.by_id: dict[str, Branch] = {root_id: self.root}
        for b in branches:
            self.add(b)

    def add(self, branch: Branch) -> Branch:
        name("branch name", branch.name, BRANCH_NAME_BYTES)
        if branch.id in self.by_id or any(b.name == branch.name for b in self.by_id.values()):
            raise BranchExistsError(branch.name)
        if branch.parent is None or branch.fork_position is None:
            raise InvalidBranchAncestryError(f"{branch.name} has no parent")
        if len(self.ancestry(branch.parent)) + 1 > LINEAGE_NODES:
            raise InvalidBranchAncestryError(f"more than {LINEAGE_NODES} branches in a line")
        self.by_id[branch.id] = branch
        return branch

    def archive(self, branch_id: str) -> Branch:
        branch = self.get(branch_id)
        if branch.parent is None:
            raise InvalidArgumentError("the root branch can't be archived")
        self.by_id[branch_id] = branch = replace(branch, status="archived")
        return branch

    def get(self, branch_id: str) -> Branch:
        try:
            return self.by_id[branch_id]
        except KeyError:
            raise BranchNotFoundError(branch_id) from None

    def named(self, branch_name: str) -> Branch:
        for b in self.by_id.values():
            if b.name == branch_name:
                return b
        raise BranchNotFoundError(branch_name)

    def children(self, branch_id: str) -> list[Branch]:
        self.get(branch_id)
        return sorted((b for b in self.by_id.values() if b.parent == branch_id), key=lambda b: b.name)

    def ancestry(self, branch_id: str) -> list[Branch]:
        """From the root to the branch."""
        line = [self.get(branch_id)]
        while line[-1].parent is not None:
            if len(line) > LINEAGE_NODES:
                raise InvalidBranchAncestryError("branches in a circle, or too many in a line")
            line.append(self.get(line[-1].parent))
        return line[::-1]

    def scopes(self, branch_id: str, until: int) -> list[tuple[str, int]]:
        """(branch, cap), root first: a record is visible if its position is below its branch's cap.  A fork sees its
        parent up to where it left it, so a cap is the least of all fork positions further down the line."""
        line, out = self.ancestry(branch_id), []
        for b in reversed(line):
            out.append((b.id, until))
            if b.fork_position is not None:
                until = min(until, b.fork_position)
        return out[::-1]

    def common_ancestor(self, left: str, right: str) -> Branch:
        return self._split(left, right)[0]

    def divergence(self, left: str, left_until: int, right: str, right_until: int) -> tuple[Branch, int]:
        """The deepest shared branch, and the position from which the timelines differ: the least of both ends and of
        the fork positions of all branches that they don't share (a fork may lie below its parent's own)."""
        ancestor, apart = self._split(left, right)
        return ancestor, min([left_until, right_until, *(b.fork_position for b in apart)])

    def _split(self, left: str, right: str) -> tuple[Branch, list[Branch]]:
        a, b = self.ancestry(left), self.ancestry(right)
        shared = [x for x, y in zip(a, b) if x.id == y.id]
        if not shared:
            raise InvalidBranchAncestryError("branches without a common root")
        return shared[-1], a[len(shared) :] + b[len(shared) :]

    def fingerprint(self, branch_id: str) -> str:
        """Identity of a branch's line, for the validity of snapshots."""
        return sha256(repr([(b.id, b.fork_position) for b in self.ancestry(branch_id)]).encode()).hexdigest()[:32]

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(b.id, b.name, b.parent, b.fork_position, b.created_at, b.status) for b in self.by_id.values()], SCHEMA)


def ancestry_frame(branches: DataFrame) -> DataFrame:
    """(branch, ancestor, depth), each branch among its own: a recursive query over a table of branches."""
    return branches.sparkSession.sql(
        f"""WITH RECURSIVE line(branch, ancestor, parent, depth) AS (
                SELECT id, id, parent, 0 FROM {{branches}}
                UNION ALL
                SELECT l.branch, b.id, b.parent, l.depth + 1 FROM line l JOIN {{branches}} b ON b.id = l.parent WHERE l.depth < {LINEAGE_NODES})
            SELECT branch, ancestor, CAST(depth AS BIGINT) AS depth FROM line""",
        branches=branches,
    )
