"""rainfold — station-climate analytics as Spark DataFrame operators.

Every public operator is DataFrame in → DataFrame out, takes its key,
time and value columns as arguments, and processes many series in one
distributed pass.  Nothing is collected to the driver.
"""

__version__ = "0.1.0"
