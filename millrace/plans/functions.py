"""Names of aggregate functions, by the classes that Catalyst has for them."""

AGGREGATES = frozenset(
    "Sum Count Average Min Max CollectList CollectSet AnyValue First Last ApproximatePercentile StddevSamp StddevPop VarianceSamp VariancePop "
    "BoolAnd BoolOr CountIf ListAgg HllSketchAgg HllUnionAgg HyperLogLogPlusPlus BitXorAgg".split()
)
