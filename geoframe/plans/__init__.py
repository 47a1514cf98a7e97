"""Multi-step plans: reconstruction, dense depth, and evaluation."""
