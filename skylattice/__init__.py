"""skylattice: spatio-temporal environmental analytics as PySpark DataFrame operators."""
