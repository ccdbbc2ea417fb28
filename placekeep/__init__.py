"""placekeep: a PySpark-native engine for place directories, their inventories and the evidence behind both."""
