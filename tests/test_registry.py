"""Every registered query runs, and no module binds a constant twice."""

import ast
from pathlib import Path

import pytest

import swapledger
from swapledger.plans import all_oracles, all_queries
from tests.compare import diff, duck

SF = "/root/testdata/sf0.001"
ROOT = Path(swapledger.__file__).parent


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("module", sorted(p.relative_to(ROOT).as_posix() for p in ROOT.rglob("*.py")))
def test_top_level_names_are_bound_once(module):
    seen = set()
    for node in ast.parse((ROOT / module).read_text()).body:
        targets = node.targets if isinstance(node, ast.Assign) else [node.target] if isinstance(node, ast.AnnAssign) else []
        for name in (x.id for t in targets for x in ast.walk(t) if isinstance(x, ast.Name) and isinstance(x.ctx, ast.Store)):
            assert name not in seen, f"{name} is bound twice"
            seen.add(name)


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query_matches_oracle(spark, con, name):
    df = all_queries()[name](spark, SF)
    if name in all_oracles():
        assert diff(df, con, all_oracles()[name]) == ""
    else:
        assert df.count() > 0
