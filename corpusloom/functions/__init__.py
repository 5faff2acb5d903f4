"""Column functions: text, arrays and predicates, all evaluated by Spark's own expressions unless said otherwise."""

from corpusloom.functions.arrays import *  # noqa: F403
from corpusloom.functions.text import *  # noqa: F403
