"""Memory that the driver no longer uses, given back to the system."""

from __future__ import annotations

import contextlib

from py4j.protocol import Py4JError
from pyspark.sql import SparkSession


def trim(spark: SparkSession) -> str | None:
    """Has the driver's JVM give back what its compilers and native libraries have freed; what it says of that.

    The C library keeps such memory for each thread; it is no part of the heap,
    so no garbage collection frees it.  None where the JVM has no such command.
    """
    gateway, java = spark.sparkContext._gateway, spark._jvm.java.lang
    with contextlib.suppress(Py4JError):
        # by reflection on the interface, as the server's own class isn't open to other modules
        kinds, given = gateway.new_array(java.Class, 4), gateway.new_array(java.Object, 4)
        for k, name in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            kinds[k] = java.Class.forName(name)
        given[0] = spark._jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        given[1] = "systemTrimNativeHeap"
        server = java.management.ManagementFactory.getPlatformMBeanServer()
        return java.Class.forName("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(server, given)
    return None
