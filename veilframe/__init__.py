"""veilframe: Spark-native data anonymisation.

Column functions (``veilframe.functions``) return ``Column`` expressions that
stay inside whole-stage codegen; operators (``veilframe.operators``) are
``DataFrame -> DataFrame`` jobs built from joins, aggregations and windows;
``veilframe.plans`` turns a declarative profile into one Spark plan.
"""

__version__ = "0.1.0"
