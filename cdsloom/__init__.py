"""Declarative CDS views on Spark: compiled into plans, their lineage, and the state of a whole corpus."""

from cdsloom.operators.certainty import certainty
from cdsloom.operators.graph import inventory
from cdsloom.operators.metrics import MARK
from cdsloom.operators.tree import Tree, tree
from cdsloom.plans.compile import frame, statement
from cdsloom.plans.guard import NotAllowed, check, read
from cdsloom.plans.names import Resolver, Settings, cleaned, folder
from cdsloom.plans.syntax import Association, Block, Item, Join, View, parse
from cdsloom.session import Result, Session, export_certainty, save
from cdsloom.sources.corpus import deduplicated, looked_up

__version__ = "0.2.0"

__all__ = [
    "MARK", "Association", "Block", "Item", "Join", "NotAllowed", "Resolver", "Result", "Session", "Settings", "Tree", "View", "certainty", "check", "cleaned",
    "deduplicated", "export_certainty", "folder", "frame", "inventory", "looked_up", "parse", "read", "save", "statement", "tree",
]
