"""Numeric kernels: numpy arrays with the model axis first, no Spark imports.

Every kernel takes a whole batch of models of one shape, so an Arrow batch of
model rows is one call.
"""
