"""Cipher states of namespaces, computed once per namespace and joined to the tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from veilcraft.functions.cipher import TokenCipher
from veilcraft.operators.joins import fits_broadcast, lookup_join
from veilcraft.session import materialize

NAMESPACE, STATE = "_namespace", "_state"


def with_states(values: DataFrame, namespace: Column, cipher: TokenCipher) -> DataFrame:
    """``values`` with the namespace of their token and its state, for any number of namespaces; NULL where there is none.

    The distinct names are written to the shared folder, never the states, which follow from the key. The join
    is broadcast if the names were counted to be few; else adaptive execution may split a namespace of many tokens.
    """
    named = values.withColumn(NAMESPACE, namespace)
    names = materialize(named.select(NAMESPACE).where(F.col(NAMESPACE).isNotNull()).distinct(), "namespaces")
    states = names.withColumn(STATE, cipher.state(NAMESPACE))
    return lookup_join(named, states, [NAMESPACE], fits_broadcast(names))
