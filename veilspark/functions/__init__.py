"""Column functions and driver-side arithmetic: noise, kernels, privacy budgets."""
