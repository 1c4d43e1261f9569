"""Backup coverage over file manifests, as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Python tasks (NFC, fingerprints of files, listing, EXIF bytes) carry their own code to the executors, so
# the package does not have to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
